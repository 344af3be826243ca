"""Explicit schemas of the graph tables and of the source files."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


TEXT, LONG, INT, DOUBLE = StringType(), LongType(), IntegerType(), DoubleType()
POINT = _struct(lat=DOUBLE, lng=DOUBLE)
CONFIDENCE, SCORE = DecimalType(4, 3), DecimalType(5, 2)

WORKS = _struct(
    work_id=LONG, wikidata_id=TEXT, tmdb_id=TEXT, imdb_id=TEXT, isbn=TEXT, mbid=TEXT, kind=TEXT,
    title=TEXT, title_norm=TEXT, year=INT, poster_path=TEXT, source=TEXT,
)
CREATORS = _struct(creator_id=LONG, name=TEXT, kind=TEXT)
WORK_CREATORS = _struct(work_id=LONG, creator_id=LONG, role=TEXT)
PLACES = _struct(
    place_id=LONG, wikidata_id=TEXT, name=TEXT, lat=DOUBLE, lng=DOUBLE, cell=LONG,
    place_class=TEXT, geocode_precision=TEXT, shot_on_set=BooleanType(), confidence=CONFIDENCE,
    confidence_band=TEXT, status=TEXT, status_reason=TEXT, footprint=ArrayType(POINT),
    frame_embedding=ArrayType(FloatType()), osm_building_id=TEXT,
)
LINKS = _struct(
    link_id=LONG, work_id=LONG, place_id=LONG, scene_id=LONG, relation_kind=TEXT, about=TEXT,
    stated_year=INT, statement=TEXT, confidence=CONFIDENCE, narrative_order=INT,
    created_at=TimestampType(),
)
CREATOR_LINKS = _struct(
    fact_id=LONG, creator_id=LONG, place_id=LONG, relation_kind=TEXT, about=TEXT,
    stated_year=INT, statement=TEXT, confidence=CONFIDENCE,
)
EVIDENCE = _struct(
    subject_type=TEXT, subject_id=LONG, method=TEXT, source_url=TEXT, source_ref=TEXT,
    snippet=TEXT, agrees=BooleanType(), weight=DOUBLE, model=TEXT, model_confidence=TEXT,
)
SCENES = _struct(
    scene_id=LONG, work_id=LONG, sequence_index=INT, act_or_chapter=TEXT, plot_beat=TEXT,
    spoiler_tier=INT, safe_teaser=TEXT,
)
CORROBORATION = _struct(
    source_kind=TEXT, submission_id=LONG, place_name=TEXT, gave_coordinate=BooleanType(),
    distance_m=DOUBLE,
)
SUBMISSIONS = _struct(
    id=LONG, work_id=LONG, place_name=TEXT, place_key=TEXT, area_hint=TEXT, source_kind=TEXT,
    source_record_id=TEXT, source_title=TEXT, source_url=TEXT, source_sentence=TEXT,
    source_license=TEXT, source_attribution=TEXT, lat=DOUBLE, lng=DOUBLE, geocode_source=TEXT,
    geocode_source_id=TEXT, geocode_reason=TEXT, status=TEXT, place_id=LONG, wikidata_id=TEXT,
    corroborated_by=ArrayType(CORROBORATION), relation_kind=TEXT,
)
RATINGS = _struct(work_id=LONG, source=TEXT, score=SCORE, display=TEXT, votes=LONG)
GEOCODE_CACHE = _struct(
    query_norm=TEXT, lat=DOUBLE, lng=DOUBLE, source=TEXT, source_id=TEXT, match_reason=TEXT,
    candidates=ArrayType(_struct(lat=DOUBLE, lng=DOUBLE, source_id=TEXT)),
)
FIXES = _struct(
    fix_id=LONG, user_id=LONG, ts=TimestampType(), lat=DOUBLE, lng=DOUBLE, accuracy_m=DOUBLE
)

# Source files.
RATINGS_DUMP = _struct(tconst=TEXT, averageRating=TEXT, numVotes=TEXT)
HARVEST_LOCATION = _struct(
    id=TEXT, name=TEXT, lat=DOUBLE, lng=DOUBLE, address=TEXT,
    appearances=ArrayType(
        _struct(
            movie_id=TEXT, scene=TEXT, as_name=TEXT, note=TEXT,
            frames=ArrayType(_struct(page=TEXT, thumb=TEXT, full=TEXT)),
        )
    ),
)
PLAQUE = _struct(
    id=TEXT, title=TEXT, inscription=TEXT, address=TEXT, area=TEXT, latitude=TEXT,
    longitude=TEXT, organisations=TEXT, erected=TEXT, series=TEXT,
)
