"""Derived views that put the content-graph shapes on the driver tables.

The same text runs in both engines: Spark evaluates it through ``Views``, the
oracle inlines it as common table expressions.
"""

FIXTURE_SQL = {
    "fx_works": """
select cast(p_partkey as bigint) work_id,
  concat(case p_partkey % 8 when 0 then 'The ' when 1 then 'A ' when 2 then 'Amélie ' when 3 then '42 ' else '' end,
         p_name, ' ', cast(p_partkey % 97 as string)) title,
  case p_partkey % 5 when 0 then 'film' when 1 then 'film' when 2 then 'series' when 3 then 'book' else 'album' end kind,
  cast(1950 + p_size as int) as year,
  case when p_partkey % 4 <> 3 then concat('tt', cast(1000000 + p_partkey as string)) end imdb_id,
  case when p_partkey % 3 = 0 then cast(p_partkey * 17 + 1 as string) end tmdb_id
from part
""",
    "fx_creators": """
select cast(s_suppkey as bigint) creator_id, s_name name,
  case s_suppkey % 4 when 0 then 'author' when 1 then 'director' when 2 then 'artist' else 'band' end kind
from supplier
""",
    "fx_work_creators": """
select distinct cast(l_partkey as bigint) work_id, cast(l_suppkey as bigint) creator_id
from lineitem where l_linenumber = 1
""",
    "fx_places": """
select cast(c_custkey as bigint) place_id,
  case when c_custkey % 3 = 0 then concat('Q', cast(c_custkey + 1 as string)) end wikidata_id,
  concat(case c_custkey % 5 when 0 then 'Union Station' when 1 then 'City Hall' when 2 then 'Old Bridge'
         when 3 then 'Café Royal' else 'Market Square' end) name,
  cast(c_nationkey as bigint) city_id,
  case when c_custkey % 50 = 49 then null else
    cast(-60 + (c_nationkey * 37) % 120 as double) + cast((c_custkey * 7919) % 41 - 20 as double) * cast(0.0001 as double)
    + cast(c_custkey % 5 - (c_custkey % 5) % 2 as double) * cast(0.008 as double) end lat,
  case when c_custkey % 50 = 49 then null else
    cast(-179 + (c_nationkey * 71) % 358 as double) + cast((c_custkey * 104729) % 43 - 21 as double) * cast(0.0001 as double) end lng,
  case when c_custkey % 20 = 0 then 'fictional' when c_custkey % 20 = 1 then 'studio_interior'
       when c_custkey % 20 = 2 then 'narrative_real' when c_custkey % 20 = 3 then 'unknown' else 'real_exterior' end place_class,
  case c_custkey % 6 when 0 then 'city' when 1 then 'street' when 2 then 'building' when 3 then 'building' else 'point' end geocode_precision,
  cast(30 + c_custkey % 70 as double) / 100 confidence,
  case when c_custkey % 10 < 7 then 'verified' when c_custkey % 10 < 9 then 'pending' else 'rejected' end status
from customer
""",
    "fx_links": """
select cast(l_partkey as bigint) * 1000000 + cast(o_custkey as bigint) link_id,
  cast(l_partkey as bigint) work_id, cast(o_custkey as bigint) place_id,
  case (l_partkey + o_custkey) % 12 when 0 then 'narrative_location' when 1 then 'author_place' when 2 then 'artist_place'
    when 3 then 'inspiration_for' when 4 then 'replica' when 5 then 'studio_of' else 'filming_location' end relation_kind,
  cast(min(l_linenumber) as int) narrative_order,
  cast((l_partkey * 31 + o_custkey * 17) % 100 as double) / 100 confidence,
  min(l_shipdate) created_at
from lineitem join orders on l_orderkey = o_orderkey
group by l_partkey, o_custkey
""",
    "fx_creator_links": """
select cast(l_suppkey as bigint) * 1000000 + cast(o_custkey as bigint) fact_id,
  cast(l_suppkey as bigint) creator_id, cast(o_custkey as bigint) place_id,
  case (l_suppkey + o_custkey) % 5 when 0 then 'lived_here' when 1 then 'worked_here' when 2 then 'wrote_here'
    when 3 then 'buried_here' else 'commemorated_here' end relation_kind,
  cast(1850 + min(l_linenumber) * 10 as int) stated_year
from lineitem join orders on l_orderkey = o_orderkey
where l_linenumber = 2
group by l_suppkey, o_custkey
""",
    "fx_evidence": """
select case when l_linenumber % 2 = 0 then 'link' else 'place' end subject_type,
  case when l_linenumber % 2 = 0 then cast(l_partkey as bigint) * 1000000 + cast(o_custkey as bigint)
       else cast(o_custkey as bigint) end subject_id,
  case l_suppkey % 9 when 0 then 'wikidata_statement' when 1 then 'wikidata_studio_entity' when 2 then 'manual_fix'
    when 3 then 'vision_verify' when 4 then 'mapillary_match' when 5 then 'commons_geosearch' when 6 then 'web_search_cited'
    when 7 then 'text_mention' else 'geoclip_infer' end method,
  case l_returnflag when 'A' then true when 'R' then false end agrees,
  case when l_partkey % 7 = 0 then l_discount end weight,
  concat('ref', cast(l_suppkey as string)) source_ref
from lineitem join orders on l_orderkey = o_orderkey
where o_custkey % 4 <> 3
""",
    "fx_scenes": """
select cast(l_partkey as bigint) work_id, cast(o_custkey as bigint) place_id,
  cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, o_custkey, l_extendedprice) as int) sequence_index,
  cast((l_orderkey + l_linenumber) % 6 as int) spoiler_tier
from lineitem join orders on l_orderkey = o_orderkey
where l_linenumber = 3
""",
    "fx_submissions": """
select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as bigint) id,
  cast(l_partkey as bigint) work_id,
  concat(case l_suppkey % 4 when 0 then 'The ' else '' end, p.name,
         case l_suppkey % 5 when 0 then ', Old Town' when 1 then ' in London, W1' else '' end) place_name,
  case l_suppkey % 7 when 0 then 'moviemaps' when 1 then 'reelstreets' when 2 then 'movielocations' when 3 then 'open_plaques'
    when 4 then 'permit_record' when 5 then 'wikipedia' else 'fandom' end source_kind,
  case l_returnflag when 'A' then 'verified' when 'R' then 'rejected' else 'pending' end status,
  case when l_linenumber % 4 = 0 then null when l_quantity = 50 then cast(0 as double) else p.lat end lat,
  case when l_linenumber % 4 = 0 then null when l_quantity = 50 then cast(0 as double) else p.lng end lng,
  case when l_linestatus = 'F' and l_returnflag = 'A' then p.place_id end place_id,
  case when l_suppkey % 2 = 0 then concat('They walked past it in scene ', cast(l_linenumber as string), ' of the film.') end source_sentence,
  concat('https://example.org/', cast(l_suppkey as string)) source_url,
  case when l_partkey % 5 = 0 then p.wikidata_id end wikidata_id
from lineitem join orders on l_orderkey = o_orderkey join fx_places p on p.place_id = o_custkey
""",
    "fx_ratings": """
select cast(p_partkey as bigint) work_id, 'imdb' source, cast(25 + (p_partkey * 37) % 70 as double) score,
  cast((p_partkey * 7919) % 200000 as bigint) votes from part where p_partkey % 6 <> 5
union all
select cast(p_partkey as bigint), 'tmdb', cast(20 + (p_partkey * 53) % 75 as double),
  cast((p_partkey * 104729) % 4000 as bigint) from part where p_partkey % 2 = 1
""",
    "fx_library": """
select distinct cast(o_custkey as bigint) user_id, cast(w.work_id as bigint) truth_work_id, w.title,
  case w.work_id % 4 when 0 then w.year + 1 when 1 then null else w.year end as year,
  case when w.work_id % 3 = 1 then w.imdb_id end imdb_id,
  case when w.work_id % 5 = 2 then w.tmdb_id end tmdb_id,
  cast(1 + (o_custkey + w.work_id) % 10 as double) rating
from lineitem join orders on l_orderkey = o_orderkey join fx_works w on w.work_id = l_partkey
where l_linenumber = 1
""",
    "fx_anchors": """
select cast(n_nationkey as bigint) anchor_id, n_name name, cast(n_regionkey as bigint) country_id,
  cast(-60 + (n_nationkey * 37) % 120 as double) lat, cast(-179 + (n_nationkey * 71) % 358 as double) lng,
  cast(1 + n_nationkey % 3 as double) radius_km
from nation
""",
    "fx_lot_vertices": """
select cast(n_nationkey as bigint) lot_id, v.i vertex_no,
  cast(-60 + (n_nationkey * 37) % 120 as double) + v.dlat lat,
  cast(-179 + (n_nationkey * 71) % 358 as double) + v.dlng lng,
  case n_nationkey % 3 when 0 then 'view_only' when 1 then 'ticketed' else 'open' end access
from nation cross join (
  select 0 i, cast(0.0005 as double) dlat, cast(0.0005 as double) dlng union all
  select 1, cast(0.0031 as double), cast(0.0007 as double) union all
  select 2, cast(0.0029 as double), cast(0.0033 as double) union all
  select 3, cast(0.0003 as double), cast(0.0027 as double)) v
""",
    "fx_type_edges": """
select cast(p_partkey as bigint) type_id, cast((p_partkey - p_partkey % 2) / 2 as bigint) parent_id
from part where p_partkey > 0
""",
    "fx_fixes": """
select cast(event_id as bigint) fix_id, cast(user_id as bigint) user_id, ts,
  cast(-60 + ((user_id % 25) * 37) % 120 as double) + cast((event_id * 31) % 41 - 20 as double) * cast(0.0001 as double) lat,
  cast(-179 + ((user_id % 25) * 71) % 358 as double) + cast((event_id * 53) % 43 - 21 as double) * cast(0.0001 as double) lng,
  value accuracy_m
from events
""",
}
