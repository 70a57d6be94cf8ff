"""SQL text of the bindings for the side-by-side check, and builders of repeated expressions.

Numbers are written as doubles (``100e0``) because a decimal literal would switch the arithmetic to decimals.
"""

import re

from fuelspark.functions import lookups, text
from fuelspark.functions.geo import GEOHASH_ALPHABET
from fuelspark.plans.bindings import AS_OF, BRAND_SPELLINGS, MASTER_STATES


def jr(x: str, digits: int = 0) -> str:
    return f"(floor(({x})*1e{digits}+0.5e0)/1e{digits})"


def cents(x: str) -> str:
    return f"CAST(floor(({x})*100e0+0.5e0) AS BIGINT)"


def mean(total: str, n: str) -> str:
    return f"(floor(({total})/({n})+0.5e0)/100e0)"


def avg_price(x: str = "price") -> str:
    return mean(f"sum({cents(x)})", f"count({x})")


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (f"(pow(sin(radians(({lat2})-({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin(radians(({lng2})-({lng1}))/2),2))")
    return f"(12742e0*atan2(sqrt({a}),sqrt(1e0-{a})))"


def man(lat1: str, lng1: str, lat2: str, lng2: str, k: str = "111.32e0") -> str:
    return f"(abs(({lat1})-({lat2}))*{k}+abs(({lng1})-({lng2}))*({k}*cos(radians((({lat1})+({lat2}))/2))))"


def std_cents(c: str = "c") -> str:
    """Population deviation in cents from power sums."""
    s, ss, n = f"sum({c})", f"sum(({c}*{c})::DOUBLE)", "count(*)"
    return f"sqrt(greatest(0e0,{ss}/{n}-({s}/{n})*({s}/{n})))"


def geohash(lat: str, lng: str, precision: int) -> str:
    lng_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    x = f"CAST(floor(({lng}+180e0)/360e0*{1 << lng_bits}) AS BIGINT)"
    y = f"CAST(floor(({lat}+90e0)/180e0*{1 << lat_bits}) AS BIGINT)"
    parts = []
    for char in range(precision):
        bits = []
        for bit in range(5 * char, 5 * char + 5):
            axis, width = (x, lng_bits) if bit % 2 == 0 else (y, lat_bits)
            bits.append(f"(({axis}//{1 << (width - 1 - bit // 2)})%2)*{1 << (4 - bit % 5)}")
        parts.append(f"substr('{GEOHASH_ALPHABET}',({'+'.join(bits)}+1)::INT,1)")
    return f"CASE WHEN {valid(lat, lng)} THEN {'||'.join(parts)} END"


def valid(lat: str, lng: str) -> str:
    b = lookups.BOUNDS
    return f"coalesce({lat} BETWEEN {b[0]}e0 AND {b[1]}e0 AND {lng} BETWEEN {b[2]}e0 AND {b[3]}e0,false)"


def quote(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def case_of(column: str, mapping: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + f" ELSE {other} END"


def rx(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x},{quote(pattern)},{quote(to)},'g')"


def upper_plain(x: str) -> str:
    return f"nullif(upper(strip_accents(trim({x}))),'')"


def collapse(x: str) -> str:
    return f"trim({rx(x, chr(92) + 's+', ' ')})"


def expand(x: str, mapping: dict) -> str:
    for word, full in mapping.items():
        x = rx(x, rf"\b{word}\b", full)
    return x


def norm_name(x: str) -> str:
    t = upper_plain(x)
    for _ in range(3):
        t = f"trim({rx(t, r'\s*\b(?:' + '|'.join(lookups.LEGAL_SUFFIXES) + r')\s*$', '')})"
    t = expand(t, lookups.NAME_ABBREVIATIONS)
    t = rx(t, r"""[.,;:!?()\[\]{}/\\"'`#@$%^&*+=<>|~]""", " ")
    t = collapse(t)
    stop = "[" + ",".join(quote(w) for w in lookups.STOP_WORDS) + "]"
    return f"nullif(array_to_string(list_sort(list_filter(string_split({t},' '),lambda w: NOT list_contains({stop},w))),' '),'')"


def comparison(norm: str) -> str:
    t = collapse(rx(norm, r"\b\d+\b", ""))
    return f"nullif(array_to_string(list_sort(string_split({t},' ')),' '),'')"


def norm_address(x: str) -> str:
    t = upper_plain(x)
    t = rx(t, text.SIN_NUMERO, "SIN NUMERO")
    t = rx(t, text.KILOMETRE, r"KILOMETRO \1")
    t = rx(t, text.NUMBER_PREFIX, r"NUMERO \1")
    t = rx(t, text.INTERIOR, "")
    street = {k: v for k, v in lookups.STREET_ABBREVIATIONS.items() if k != "C"}
    t = expand(expand(expand(t, lookups.SETTLEMENT_ABBREVIATIONS), street), {"C": "CALLE"})
    return f"nullif({collapse(t)},'')"


def norm_state(x: str) -> str:
    t = upper_plain(x)
    return f"coalesce({case_of(t, lookups.STATE_ALIASES)},{case_of(f'trim(replace({t},{quote(chr(46))},{quote(str())}))', lookups.STATE_ALIASES)},{t})"


def norm_zip(x: str) -> str:
    d = rx(x, r"\D", "")
    return f"CASE WHEN length({d}) BETWEEN 1 AND 5 THEN lpad({d},5,'0') END"


def precision_class(lat: str, lng: str) -> str:
    def places(v):
        return f"length(regexp_replace(printf('%.10f',{v}),'^.*\\.|0+$','','g'))"
    least = f"least({places(lat)},{places(lng)})"
    return f"CASE WHEN {lat} IS NULL OR {lng} IS NULL THEN 'none' WHEN {least}<=2 THEN 'low' WHEN {least}=3 THEN 'medium' ELSE 'high' END"


def _pick(names: list, index: str) -> str:
    return f"([{','.join(quote(n) for n in names)}])[{index}]"


def _brand_view() -> str:
    """Canonical brand of every distinct raw brand, by the four rules in turn."""
    rows = ",".join(f"({i},{quote(a)},{quote(b)})" for i, (a, b) in enumerate(lookups.BRAND_ALIASES.items()))
    known = ",".join(f"({i},{quote(b)})" for i, b in enumerate(lookups.BRANDS))
    return f"""
 aliases(pos,alias,canon) AS (VALUES {rows}), known(pos,brand) AS (VALUES {known}),
 brand_keys AS (SELECT DISTINCT raw_brand, {collapse(upper_plain('raw_brand'))} k FROM raw_staging WHERE raw_brand IS NOT NULL),
 brand_need AS (SELECT DISTINCT array_to_string(list_sort(string_split(k,' ')),' ') a, array_to_string(list_sort(string_split(t,' ')),' ') b
   FROM brand_keys, (SELECT brand t FROM known UNION SELECT alias FROM aliases)),
 brand_lcs AS ({lcs_sql('brand_need')}),
 brand_hit AS (SELECT raw_brand, k,
   (SELECT count(*) FROM aliases WHERE alias=k)>0 exact, (SELECT max(canon) FROM aliases WHERE alias=k) exact_canon,
   (SELECT min(pos) FROM aliases WHERE (contains(k,alias) OR contains(alias,k)) AND least(length(alias),length(k))>=4) sub_pos,
   (SELECT brand FROM (SELECT brand, 200e0*l/(length(a)+length(b)) r, pos FROM known JOIN brand_lcs
      ON a=array_to_string(list_sort(string_split(k,' ')),' ') AND b=array_to_string(list_sort(string_split(brand,' ')),' ')) WHERE r>=80 ORDER BY r DESC, pos LIMIT 1) near_brand,
   (SELECT pos FROM (SELECT 200e0*l/(length(a)+length(b)) r, pos FROM aliases JOIN brand_lcs
      ON a=array_to_string(list_sort(string_split(k,' ')),' ') AND b=array_to_string(list_sort(string_split(alias,' ')),' ')) WHERE r>=82 ORDER BY r DESC, pos LIMIT 1) near_pos
   FROM brand_keys),
 brands AS (SELECT raw_brand, CASE WHEN exact THEN exact_canon WHEN sub_pos IS NOT NULL THEN (SELECT canon FROM aliases WHERE pos=sub_pos)
     WHEN near_brand IS NOT NULL THEN near_brand ELSE (SELECT canon FROM aliases WHERE pos=near_pos) END norm_brand, exact, sub_pos IS NOT NULL sub FROM brand_hit)"""


def lcs_sql(need: str) -> str:
    """Longest common subsequence of every pair (a, b) of a relation, one bit step per character of b."""
    return f"""SELECT a, b, (length(a)-bit_count(list_reduce(list_transform(string_split(b,''), lambda ch: coalesce(masks[ch],0::HUGEINT)),
   lambda row, m: (((row+(row&m))|(row-(row&m)))&(((1::HUGEINT)<<length(a))-1)), ((1::HUGEINT)<<length(a))-1)))::BIGINT l
   FROM {need} JOIN (SELECT s, map_from_entries(list((ch,m))) masks FROM (SELECT s, ch, sum((1::HUGEINT)<<(i-1))::HUGEINT m
     FROM (SELECT s, unnest(string_split(s,'')) ch, generate_subscripts(string_split(s,''),1) i FROM (SELECT DISTINCT a s FROM {need} WHERE a<>''))
     GROUP BY s, ch) GROUP BY s) ON s=a WHERE b<>''"""


FUEL_OF_FLAG = "CASE l_returnflag WHEN 'A' THEN 'regular' WHEN 'N' THEN 'premium' WHEN 'R' THEN 'diesel' END"
FUEL_OF_EVENT = "CASE WHEN event_type IN ('view','signup') THEN 'regular' WHEN event_type IN ('click','error') THEN 'premium' WHEN event_type='purchase' THEN 'diesel' END"
_LB = "(substr(l.p_brand,7,3)::INT)%8+1"

VIEWS = {
    "stations": """stations AS (SELECT s_suppkey id, s_name AS name, 'BRAND_'||(s_suppkey%7) brand, 'CITY_'||(s_suppkey%12) city,
 n_name state, r_name region, 19e0+((s_suppkey*37)%100)/500e0 lat, -99.4e0+((s_suppkey*53)%97)/480e0 lng
 FROM (SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT n_nationkey+1000000, 'Planned '||n_name, n_nationkey FROM nation) JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)""",
    "prices": f"""prices AS (SELECT id, fuel, floor(s*(CASE WHEN id%41=7 THEN 13 ELSE 10 END)/(n*20000e0)+0.5e0)/100e0 price FROM (SELECT l_suppkey id, {FUEL_OF_FLAG} fuel,
 sum({cents('l_extendedprice')}) s, count(*) n FROM lineitem GROUP BY 1,2) WHERE fuel IS NOT NULL)""",
    "pw": """pw AS (SELECT id, max(price) FILTER (fuel='regular') regular, max(price) FILTER (fuel='premium') premium,
 max(price) FILTER (fuel='diesel') diesel FROM prices GROUP BY id)""",
    "merged": """merged AS (SELECT s.*, regular, premium, diesel, coalesce(regular,premium,diesel) IS NOT NULL has_data
 FROM stations s LEFT JOIN pw USING(id))""",
    "priced": "priced AS (SELECT s.*, fuel, price FROM stations s JOIN prices USING(id))",
    "snapshots": f"""snapshots AS (SELECT user_id%15 id, CAST(ts AS DATE) "date", {FUEL_OF_EVENT} fuel, {avg_price('value')} price
 FROM events GROUP BY 1,2,3)""",
    "tx": f"""tx AS (SELECT l_orderkey||'-'||l_linenumber tx_id, o_custkey vehicle_id, l_suppkey station_id, CAST(l_shipdate AS DATE) "date", l_quantity liters,
 floor(l_extendedprice*100/2000e0+0.5e0)/100e0 charged_price, {FUEL_OF_FLAG} fuel FROM lineitem JOIN orders ON l_orderkey=o_orderkey)""",
    "route_points": """route_points AS (SELECT (c_custkey//150)*10+(c_custkey%150)%10 route_id, (c_custkey%150)//10 seq,
 19e0+0.025e0*((c_custkey%150)//10)+0.001e0*((c_custkey//150)%10) lat, -99.4e0+0.04e0*((c_custkey%150)%10) lng FROM customer)""",
    "raw_staging": f"""raw_staging AS (SELECT CASE r WHEN 0 THEN 'cre' WHEN 1 THEN 'osm' ELSE 'denue' END||'_'||lpad(k::VARCHAR,12,'0') id,
 CASE r WHEN 0 THEN 'cre' WHEN 1 THEN 'osm' ELSE 'denue' END source,
 CASE WHEN r=0 THEN 'GASOLINERA '||nm WHEN r=1 AND z%4=0 THEN 'Gaso. '||replace(nm,'e','') WHEN r=1 THEN 'Gaso. '||nm
   WHEN z%3=0 THEN 'EST. DE SERV. '||nm||' NORTE 12, S.A. DE C.V.' ELSE 'GASOLINERA '||nm||' S.A. DE C.V.' END raw_name,
 CASE WHEN r=0 THEN {_pick(BRAND_SPELLINGS['cre'], 'b')} WHEN r=1 THEN {_pick(BRAND_SPELLINGS['osm'], 'b')} WHEN z%2=0 THEN {_pick(BRAND_SPELLINGS['denue'], 'b')} END raw_brand,
 CASE WHEN r=0 THEN 'AV. '||ty||' No. '||z||' COL. '||nm WHEN r=1 THEN 'Avenida '||ty||' '||z
   WHEN z%5<>0 THEN 'CALLE '||ty||' #'||z||', COLONIA '||nm END raw_address,
 CASE WHEN r=0 AND g%50=7 THEN 'Isla '||k ELSE 'Mún '||z||CASE WHEN r=1 THEN ', Jal.' ELSE '' END END raw_municipality, CASE WHEN r=1 THEN lower(ty) ELSE ty END raw_state,
 CASE WHEN r=1 THEN 'C.P. '||(z+1000) ELSE (z+1000)::VARCHAR END raw_zip,
 CASE WHEN r=2 AND z%10=0 THEN NULL ELSE 19e0+((g*37)%1000)/500e0+r*0.0005e0+CASE WHEN r=0 AND g%50=7 THEN 5e0 ELSE 0e0 END END lat,
 CASE WHEN r=2 AND z%10=0 THEN NULL ELSE -100e0+((g*53)%997)/500e0 END lng,
 CASE WHEN r=0 THEN 'PL/'||(g//2)||'/EXP/ES/2015' END cre_id, TIMESTAMP '2024-01-31' - to_days((g%40)::INT) fetched_at, k
 FROM (SELECT p.p_partkey k, p.p_partkey%3 r, p.p_partkey//3 g, l.p_name nm, l.p_type ty, l.p_size z, {_LB} b
   FROM part p JOIN part l ON l.p_partkey=p.p_partkey-p.p_partkey%3))""",
    "brands": _brand_view().strip(),
    "conformed": f"""conformed AS (SELECT r.*, norm_brand, CASE WHEN norm_brand IS NULL THEN 0e0 WHEN exact THEN 1e0 WHEN sub THEN 0.85e0 ELSE 0.7e0 END brand_confidence,
 {norm_name('raw_name')} norm_name, {norm_address('raw_address')} norm_address,
 nullif({collapse(f"string_split({upper_plain('raw_municipality')},',')[1]")},'') norm_municipality, {norm_state('raw_state')} norm_state, {norm_zip('raw_zip')} norm_zip
 FROM raw_staging r LEFT JOIN brands USING(raw_brand))""",
    "keys": f"""keys AS (SELECT id, source, lat, lng, coalesce({comparison('norm_name')},upper(coalesce(norm_name,raw_name))) name_key, norm_brand,
 upper(coalesce(norm_address,raw_address)) addr_key, CASE WHEN norm_state IS NOT NULL THEN norm_state||'|'||coalesce(norm_municipality,'__unknown__') END block,
 CASE WHEN lat IS NOT NULL THEN CAST(floor((lng+180e0)/360e0*32768) AS BIGINT) END cx, CASE WHEN lat IS NOT NULL THEN CAST(floor((lat+90e0)/180e0*32768) AS BIGINT) END cy FROM conformed)""",
    "blocked": f"""blocked AS (SELECT a.id id_a, b.id id_b, a.source source_a, b.source source_b, a.name_key name_a, b.name_key name_b, a.addr_key addr_a, b.addr_key addr_b,
 a.norm_brand brand_a, b.norm_brand brand_b, a.lat lat_a, a.lng lng_a, b.lat lat_b, b.lng lng_b,
 coalesce(abs(a.cx-b.cx)<=1 AND abs(a.cy-b.cy)<=1,false) in_ring, coalesce(a.block=b.block,false) in_block, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}*1000e0 m
 FROM keys a JOIN keys b ON a.id<b.id AND a.source<>b.source AND (a.block=b.block OR (abs(a.cx-b.cx)<=1 AND abs(a.cy-b.cy)<=1)))""",
}

_REL = case_of("{}", {k: v for k, v in lookups.SOURCE_RELIABILITY.items()}, "'0.5'")
_SRC = "(" + _REL.format("source_a") + ")::DOUBLE", "(" + _REL.format("source_b") + ")::DOUBLE"
VIEWS["known_scores"] = f"""known_scores AS (SELECT *, {jr('m', 1)} distance_m,
 CASE WHEN m IS NULL THEN 0.3e0 WHEN m<=500 THEN {jr('1e0-m/500e0', 4)} WHEN m<=1000 THEN {jr('greatest(0e0,0.5e0-(m-500e0)/500e0)', 4)} ELSE 0e0 END geo_score,
 CASE WHEN brand_a IS NULL AND brand_b IS NULL THEN 0.5e0 WHEN brand_a IS NULL OR brand_b IS NULL THEN 0.3e0 WHEN brand_a=brand_b THEN 1e0 ELSE 0e0 END brand_score,
 {jr(f'({_SRC[0]}+{_SRC[1]})/2', 4)} source_score FROM blocked)"""


def composite(name: str, addr: str) -> str:
    w = lookups.WEIGHTS
    total = f"{name}*{w['name']}e0+geo_score*{w['geo']}e0+brand_score*{w['brand']}e0+{addr}*{w['address']}e0+source_score*{w['source']}e0"
    return jr(f"greatest(0e0,least(1e0,{total}))", 4)


_BEST = composite("(CASE WHEN name_a IS NULL OR name_b IS NULL THEN 0.3e0 ELSE 1e0 END)", "(CASE WHEN addr_a IS NULL OR addr_b IS NULL THEN 0.3e0 ELSE 1e0 END)")
VIEWS["candidates"] = f"candidates AS (SELECT *, CASE WHEN in_ring THEN 'geohash' ELSE 'admin' END reason FROM known_scores WHERE {_BEST}>=0.65e0)"

_SORT = "array_to_string(list_sort(string_split({},' ')),' ')"


def _text_views(kind: str, with_set: bool) -> str:
    """Similarity of every distinct pair of texts: token sort, best window and, for names, token set."""
    p = kind
    setpart = f""",
 {p}_set AS (SELECT x, y, array_to_string(list_sort(list_intersect(tx,ty)),' ') cm, array_to_string(list_sort(list_filter(tx,lambda w: NOT list_contains(ty,w))),' ') ra,
   array_to_string(list_sort(list_filter(ty,lambda w: NOT list_contains(tx,w))),' ') rb
   FROM (SELECT x, y, list_distinct(string_split(x,' ')) tx, list_distinct(string_split(y,' ')) ty FROM {p}_pairs))""" if with_set else ""
    setneed = f" UNION SELECT ra, rb FROM {p}_set" if with_set else ""
    setscore = f""",
 {p}_setscore AS (SELECT x, y, CASE WHEN cm<>'' AND (ra='' OR rb='') THEN 100e0 ELSE greatest(
     200e0*((CASE WHEN cm<>'' AND ra<>'' THEN length(cm)+1 ELSE length(cm) END)+coalesce(l,0))
       /((length(cm)+(CASE WHEN cm<>'' AND ra<>'' THEN 1 ELSE 0 END)+length(ra))+(length(cm)+(CASE WHEN cm<>'' AND rb<>'' THEN 1 ELSE 0 END)+length(rb))),
     CASE WHEN cm<>'' THEN greatest(200e0*length(cm)/(2*length(cm)+1+length(ra)),200e0*length(cm)/(2*length(cm)+1+length(rb))) ELSE 0e0 END) END s
   FROM {p}_set LEFT JOIN {p}_lcs ON a=ra AND b=rb)""" if with_set else ""
    setjoin = f" JOIN {p}_setscore ss ON ss.x=p.x AND ss.y=p.y" if with_set else ""
    setval = ",ss.s" if with_set else ""
    return f"""{p}_pairs AS (SELECT DISTINCT {p}_a x, {p}_b y FROM candidates WHERE {p}_a IS NOT NULL AND {p}_b IS NOT NULL),
 {p}_windows AS (SELECT x, y, s, substr(t, greatest(1,e-length(s)+1)::INT, (least(e,length(t))-greatest(0,e-length(s)))::INT) w FROM (
   SELECT x, y, s, t, unnest(range(1,length(s)+length(t))) e FROM (
     SELECT x, y, CASE WHEN length(x)<=length(y) THEN x ELSE y END s, CASE WHEN length(x)<=length(y) THEN y ELSE x END t FROM {p}_pairs
     UNION ALL SELECT x, y, y, x FROM {p}_pairs WHERE length(x)=length(y)))){setpart},
 {p}_need AS (SELECT DISTINCT s a, w b FROM {p}_windows UNION SELECT {_SORT.format('x')}, {_SORT.format('y')} FROM {p}_pairs{setneed}),
 {p}_lcs AS ({lcs_sql(f'{p}_need')}){setscore},
 {p}_best AS (SELECT x, y, max(200e0*l/(length(s)+length(w))) r FROM {p}_windows JOIN {p}_lcs ON a=s AND b=w GROUP BY x, y),
 {p}_scores AS (SELECT p.x, p.y, {jr(f'greatest(200e0*l.l/(length(p.x)+length(p.y)),w.r{setval})/100e0', 4)} score FROM {p}_pairs p
   JOIN {p}_lcs l ON l.a={_SORT.format('p.x')} AND l.b={_SORT.format('p.y')} JOIN {p}_best w ON w.x=p.x AND w.y=p.y{setjoin})"""


VIEWS["name_scores"] = _text_views("name", True)
VIEWS["addr_scores"] = _text_views("addr", False)
VIEWS["scored"] = f"""scored AS (SELECT *, {composite('name_score', 'address_score')} composite FROM (SELECT c.*, coalesce(n.score,0.3e0) name_score, coalesce(d.score,0.3e0) address_score
 FROM candidates c LEFT JOIN name_scores n ON n.x=name_a AND n.y=name_b LEFT JOIN addr_scores d ON d.x=addr_a AND d.y=addr_b))"""
# the sequential rule itself: one edge after the other, best first
VIEWS["accepted"] = """edges AS (SELECT id_a, id_b, composite, row_number() OVER (ORDER BY composite DESC, id_a, id_b) k FROM scored WHERE composite>=0.85e0),
 walk AS (WITH RECURSIVE w(k, taken, ok) AS (SELECT 0::BIGINT, MAP([''],[true]), false
   UNION ALL SELECT w.k+1, CASE WHEN taken[id_a] IS NULL AND taken[id_b] IS NULL THEN map_concat(taken, MAP([id_a,id_b],[true,true])) ELSE taken END,
     taken[id_a] IS NULL AND taken[id_b] IS NULL FROM w JOIN edges e ON e.k=w.k+1) SELECT k, ok FROM w),
 accepted AS (SELECT id_a, id_b FROM edges JOIN walk USING(k) WHERE ok)"""
VIEWS["decisions"] = """decisions AS (SELECT s.*, CASE WHEN composite>=0.85e0 AND a.id_a IS NOT NULL THEN 'auto_match' WHEN composite>=0.65e0 THEN 'review_queue' ELSE 'rejected' END decision
 FROM scored s LEFT JOIN accepted a ON a.id_a=s.id_a AND a.id_b=s.id_b)"""
_states = _pick(MASTER_STATES, "(c_custkey%9+1)")
VIEWS["masters"] = f"""masters AS (SELECT 'mst_'||lpad(c_custkey::VARCHAR,12,'0') master_id, CASE WHEN c_custkey%4<>0 THEN 'PL/'||(c_custkey//3)||'/EXP/ES/2015' END pl_number,
 CASE WHEN c_custkey%50=0 THEN NULL WHEN c_custkey%51=0 THEN '' ELSE upper(c_name) END canonical_name, CASE WHEN c_custkey%5<>0 THEN 'BRAND_'||(c_custkey%7) END canonical_brand,
 CASE WHEN c_custkey%6<>0 THEN 'CALLE '||(c_custkey%97) END canonical_address,
 'MUN '||(c_custkey%40) canonical_municipality, {_states} canonical_state, lpad((c_custkey%99999)::VARCHAR,5,'0') canonical_zip,
 CASE WHEN c_custkey%13<>0 THEN 14e0+((c_custkey*37)%1000)/50e0 END lat, CASE WHEN c_custkey%13<>0 AND c_custkey%17<>0 THEN -119e0+((c_custkey*53)%997)/30e0 END lng,
 CASE WHEN c_custkey%6=0 THEN 'closed' ELSE 'active' END status, floor((c_acctbal+1000)/11000*10000+0.5e0)/10000e0 confidence_score, 'source_'||(c_custkey%4) primary_source,
 c_custkey%4+1 n_sources, c_custkey::VARCHAR cre_place_id, CASE WHEN c_custkey%2=0 THEN 'PL/'||c_custkey END cre_id,
 TIMESTAMP '{AS_OF}' - to_days((c_custkey%200)::INT) last_refreshed_at, TIMESTAMP '{AS_OF}' - to_days((c_custkey%120)::INT) last_confirmed_at,
 c_custkey%23=0 name_drift_flag, c_custkey%5=0 review_flag, CASE WHEN c_custkey%46=0 THEN 'renamed by owner' END review_reason, c_custkey k FROM customer)"""
VIEWS["reports"] = f"""reports AS (SELECT event_id report_id, ts, event_id%40 user_id, user_id id, {FUEL_OF_EVENT} fuel, value price,
 19e0+((user_id*37)%100)/500e0+(event_id%10)*0.001e0 lat, -99.4e0+((user_id*53)%97)/480e0 lng FROM events)"""
VIEWS["reports_ok"] = f"""reports_ok AS (SELECT r.* FROM reports r JOIN stations s USING(id) WHERE price BETWEEN 5 AND 50 AND {hav('r.lat', 'r.lng', 's.lat', 's.lng')}<=0.6e0)"""
_LOCAL_Z = "CASE WHEN lo<hi THEN (c-mu)/sd WHEN c=lo THEN 0e0 WHEN abs(c-mu)/mu>0.05e0 THEN sgn*2.5e0 END"
VIEWS["local_stats"] = f"""local_stats AS (SELECT a.id, a.fuel, count(*) nearby_count, sum({cents('b.price')}) s, {std_cents(cents('b.price'))} sd, min({cents('b.price')}) lo, max({cents('b.price')}) hi,
 quantile_cont({cents('b.price')}::DOUBLE,0.25) q1, quantile_cont({cents('b.price')}::DOUBLE,0.75) q3
 FROM priced a JOIN priced b ON a.fuel=b.fuel AND a.id<>b.id AND {jr(hav('a.lat', 'a.lng', 'b.lat', 'b.lng'), 2)}<=10
 WHERE a.fuel IN (SELECT fuel FROM priced GROUP BY fuel HAVING count(*)>=3) GROUP BY 1,2 HAVING count(*)>=2)"""
VIEWS["judged"] = f"""judged AS (SELECT *, coalesce({_LOCAL_Z}, sgn*1.5e0) z, coalesce(abs({_LOCAL_Z})>=1.5e0,false) by_z, c<q1-1.5e0*(q3-q1) OR c>q3+1.5e0*(q3-q1) outside FROM (
   SELECT p.*, l.* EXCLUDE (id, fuel), {cents('price')} c, s/nearby_count mu, CASE WHEN {cents('price')}>s/nearby_count THEN 1e0 ELSE -1e0 END sgn FROM priced p JOIN local_stats l USING(id, fuel)))"""
VIEWS["anomalies"] = f"""anomalies AS (SELECT id, name, brand, city, state, region, lat, lng, fuel, price, {mean('s', 'nearby_count')} local_avg, {jr('z', 2)} z_score, CASE WHEN z>0 THEN 'high' ELSE 'low' END direction, nearby_count,
   CASE WHEN abs(z)>3 THEN 'severe' WHEN abs(z)>2 THEN 'moderate' ELSE 'mild' END severity FROM judged WHERE by_z OR outside)"""
_DEPENDS = {
    "pw": ["prices"], "merged": ["stations", "pw"], "priced": ["stations", "prices"], "brands": ["raw_staging"],
    "conformed": ["raw_staging", "brands"], "keys": ["conformed"], "blocked": ["keys"], "known_scores": ["blocked"],
    "candidates": ["known_scores"], "name_scores": ["candidates"], "addr_scores": ["candidates"],
    "scored": ["candidates", "name_scores", "addr_scores"], "accepted": ["scored"], "decisions": ["scored", "accepted"],
    "reports_ok": ["reports", "stations"], "local_stats": ["priced"], "judged": ["priced", "local_stats"], "anomalies": ["judged"],
}


def with_views(body: str) -> str:
    """Prefix the views a query names, in order of dependence."""
    needed: list[str] = []

    def add(name: str) -> None:
        for d in _DEPENDS.get(name, []):
            add(d)
        if name not in needed:
            needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            add(name)
    body = body.strip()
    if not needed:
        return body
    views = ",\n".join(VIEWS[n] for n in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
