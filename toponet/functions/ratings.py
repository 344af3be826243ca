"""Rating scales and notability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import half_up

# Scale of a source, label of a provider, votes needed, fame exchange rate.
SOURCE_SCALE = {"imdb": 10.0, "tmdb": 10.0, "rotten_tomatoes": 100.0, "metacritic": 100.0}
LIBRARY_SCALE = {"letterboxd": 5.0, "imdb": 10.0}
PROVIDER_SOURCES = {
    "internet movie database": "imdb",
    "rotten tomatoes": "rotten_tomatoes",
    "metacritic": "metacritic",
}
RATING_ORDER = ["imdb", "rotten_tomatoes", "metacritic", "tmdb"]
MIN_VOTES = {"imdb": 1000, "tmdb": 19}
IMDB_VOTES_PER_TMDB_VOTE = 53


def normalize_score(display: Column) -> Column:
    """"92%" or "8.8/10" as 0..100 with two decimals, NULL for anything else."""
    percent = F.regexp_extract(display, r"^(\d+(?:\.\d+)?)\s*%$", 1).try_cast("double")
    fraction = r"^(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)$"
    score = F.regexp_extract(display, fraction, 1).try_cast("double")
    out_of = F.regexp_extract(display, fraction, 2).try_cast("double")
    value = F.coalesce(percent, score / F.when(out_of > 0, out_of) * 100)
    return F.when(value.between(0, 100), half_up(value, 2))


def in_source_scale(source: Column, stored: Column) -> Column:
    """Stored 0..100 score in the scale its source shows."""
    scale = (
        F.when(source.isin("imdb", "tmdb"), 10.0).otherwise(100.0)
    )
    return half_up(stored * scale / 100, 1)


def to_ten_point(rating: Column, source: Column) -> Column:
    """Own rating on the ten-point scale; zero and below mean "not rated"."""
    scale = F.when(source == "letterboxd", 5.0).otherwise(10.0)
    return F.when(rating > 0, half_up(rating * 10 / scale, 1))


def fame(source: Column, votes: Column) -> Column:
    """Votes on one footing: a vote of the smaller site counts 53."""
    return F.when(source == "tmdb", votes * IMDB_VOTES_PER_TMDB_VOTE).otherwise(votes)


def notability(source: Column, score: Column, votes: Column) -> Column:
    """score * log10(fame); NULL below the votes the source needs."""
    enough = votes >= F.when(source == "tmdb", MIN_VOTES["tmdb"]).otherwise(MIN_VOTES["imdb"])
    return F.when(enough, score * F.log10(fame(source, votes).cast("double")))
