"""SQL snippets shared by oracle texts."""

from __future__ import annotations

from ..functions.fold import BLANKS
from ..functions.phrases import (
    AREA_PREPOSITION,
    BARE_CODE,
    BARE_LOCATIVE,
    COMMON_NOUNS,
    LOCATIVE,
    OUTWARD_CODE,
    ROAD_NUMBER,
)


def quoted(values) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def title_key(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', ' ', 'g'))"


def name_key(c: str) -> str:
    bare = f"regexp_replace(strip_accents(lower({c})), '[''’‘`´]', '', 'g')"
    return f"trim(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def squash(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {text(BLANKS)}, ' ', 'g'))"


def tidy(c: str) -> str:
    return f"trim(regexp_replace({squash(c)}, '[,;:.]+$', ''))"


def words(c: str) -> str:
    return (
        f"case when coalesce(trim({c}), '') = '' then 0 "
        f"else len(regexp_split_to_array(trim({c}), '\\s+')) end"
    )


def head(c: str) -> str:
    first = tidy(f"split_part(coalesce({c}, ''), ',', 1)")
    bare = f"regexp_replace({first}, '(?i)^(?:the|a|an)\\s+', '')"
    explicit = f"regexp_replace({bare}, {text(LOCATIVE)}, '')"
    cut = f"regexp_replace({explicit}, {text(BARE_LOCATIVE)}, '')"
    return tidy(f"case when ({words(cut)}) >= 2 then {cut} else {explicit} end")


def areas(c: str) -> str:
    """List of areas, in order, each once."""
    clauses = f"[t for t in [{tidy('x')} for x in string_split(coalesce({c}, ''), ',')] if t <> '']"
    cut = f"regexp_replace(x, {text(OUTWARD_CODE)}, '')"
    named = f"[{tidy(cut)} for x in ({clauses})[2:]]"
    several = f"[t for t in {named} if t <> '' and not regexp_matches(t, {text(BARE_CODE)})]"
    inside = f"regexp_extract({c}, '(?i)\\bin\\s+([^,]{{2,40}})$', 1)"
    single = tidy(f"regexp_replace({inside}, {text(OUTWARD_CODE)}, '')")
    return (
        f"case when len({clauses}) < 2 then case when {single} <> '' then [{single}] "
        f"else cast([] as varchar[]) end else {several} end"
    )


def head_refusal(c: str) -> str:
    return (
        f"case when {tidy(c)} = '' then 'no_head' "
        f"when not regexp_matches({tidy(c)}, '\\p{{L}}|\\d') then 'head_has_no_letters' "
        f"when regexp_matches({tidy(c)}, {text(ROAD_NUMBER)}) then 'road_is_a_line_not_a_point' "
        f"when length({name_key(tidy(c))}) < 3 then 'head_too_short' "
        f"when {name_key(tidy(c))} in ({quoted(COMMON_NOUNS)}) then 'head_is_a_common_noun' end"
    )


def area_keys(c: str) -> str:
    cut = f"regexp_replace(a, {text(AREA_PREPOSITION)}, '')"
    return f"[k for k in [{name_key(cut)} for a in ({areas(c)})] if k <> '']"


def half_up(x: str, digits: int = 0) -> str:
    scale = float(10**digits)
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def metres(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"(12742000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def flat_km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"sqrt(pow(({lat1} - {lat2}) * 111.32, 2) + "
        f"pow(({lng1} - {lng2}) * 111.32 * cos(radians({lat1})), 2))"
    )


def flat_m(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"sqrt(pow(({lat1} - {lat2}) * 111320.0, 2) + "
        f"pow(({lng1} - {lng2}) * 111320.0 * cos(radians({lat1})), 2))"
    )


def names_match(a: str, b: str) -> str:
    """For already normalized names."""
    na, nb = f"len(string_split({a}, ' '))", f"len(string_split({b}, ' '))"
    return (
        f"({a} <> '' and {b} <> '' and ({a} = {b} or (abs({na} - {nb}) <= 1 and "
        f"case when {na} <= {nb} then ends_with({b}, {a}) or starts_with({b}, {a}) "
        f"else ends_with({a}, {b}) or starts_with({a}, {b}) end)))"
    )


SUPPORTED_PLACES = (
    "select distinct subject_id from fx_evidence "
    "where subject_type = 'place' and agrees is not false"
)

MAPPABLE = (
    "select p.* from fx_places p where p.lat is not null and p.place_class <> 'fictional' "
    "and p.confidence >= 0.4 and p.status = 'verified' "
    f"and p.place_id in ({SUPPORTED_PLACES})"
)

VISIBLE_QUEUE = (
    "select * from fx_submissions where status <> 'rejected' and lat is not null "
    "and lng is not null and not (lat = 0 and lng = 0) and place_id is null"
)
