"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code: plain SQL over the driver's views
(orders, customer, nation, part, lineitem, documents).  Blocks are CTEs that
later blocks build on; ``sql(name)`` assembles the statement for one query.
"""

from __future__ import annotations

NUMERIC_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?$"
INFINITY_RE = r"^[+-]?(inf|infinity)$"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def num(x: str) -> str:
    t = stripped(x)
    return (f"CASE WHEN regexp_full_match(lower({x}), '{INFINITY_RE}') THEN TRY_CAST({x} AS DOUBLE) "
            f"WHEN regexp_full_match(lower({t}), '{NUMERIC_RE}') AND NOT isinf(TRY_CAST({t} AS DOUBLE)) "
            f"THEN TRY_CAST({t} AS DOUBLE) END")


def integral(x: str) -> str:
    d = num(x)
    t = stripped(x)
    return (f"COALESCE(CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN TRY_CAST({t} AS BIGINT) END, "
            f"CASE WHEN ({d}) = floor({d}) AND abs({d}) < 9.0e18 THEN CAST({d} AS BIGINT) END)")


RAW_LISTINGS = """raw_listings AS (
SELECT CASE WHEN o.o_orderkey % 211 = 7 THEN ' ' || CAST(o.o_orderkey AS STRING) || ' '
       WHEN o.o_orderkey % 223 = 5 THEN CAST(o.o_orderkey + 100000000000000000 AS STRING)
       WHEN o.o_orderkey % 227 = 3 THEN CAST(o.o_orderkey AS STRING) || '.0' ELSE CAST(o.o_orderkey AS STRING) END AS id,
  CASE WHEN o.o_orderkey % 61 = 0 THEN NULL WHEN o.o_orderkey % 499 = 88 THEN 'Quarter ' || CAST(o.o_orderkey AS STRING)
       ELSE n.n_name END AS neighbourhood_cleansed,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE '48.' || CAST(8566 + (o.o_custkey % 200 - 100) * 5 AS STRING) END AS latitude,
  '2.' || CAST(3522 + (o.o_orderkey % 300 - 150) * 3 AS STRING) AS longitude,
  CASE WHEN o.o_orderkey % 53 = 1 THEN p.p_name || ' boat' WHEN o.o_orderkey % 59 = 2 THEN 'Loft ' || p.p_name
       ELSE p.p_name END AS property_type, o.o_orderpriority AS room_type,
  CASE WHEN o.o_orderkey % 89 = 0 THEN NULL WHEN o.o_orderkey % 47 = 3 THEN '2.5' WHEN o.o_orderkey % 97 = 5 THEN '1e1'
       WHEN o.o_orderkey % 83 = 4 THEN ' 3 ' ELSE CAST(o.o_orderkey % 9 AS STRING) END AS accommodates,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderkey % 5 AS STRING) END AS bedrooms,
  CASE WHEN o.o_orderkey % 13 = 0 THEN 'N/A' WHEN o.o_orderkey % 101 = 1 THEN '1d'
       WHEN o.o_orderkey % 103 = 2 THEN 'nan' ELSE CAST(1 + o.o_orderkey % 6 AS STRING) END AS beds,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE CAST(o.o_orderkey % 4 AS STRING) || '.5' END AS bathrooms,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL WHEN o.o_orderkey % 31 = 0 THEN '[]'
       ELSE '["' || replace(p.p_name, ' ', '", "') || '"]' END AS amenities,
  CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
       WHEN o.o_totalprice >= 100000 THEN '$' || CAST(CAST(floor(o.o_totalprice / 100000) AS BIGINT) AS STRING) || ','
            || lpad(CAST(CAST(floor(o.o_totalprice / 100) AS BIGINT) % 1000 AS STRING), 3, '0') || '.00'
       ELSE '$' || CAST(CAST(floor(o.o_totalprice / 100) AS BIGINT) AS STRING) || '.00' END AS price,
  CASE WHEN o.o_orderkey % 43 = 2 THEN '1.5' WHEN o.o_orderkey % 41 = 3 THEN '0'
       ELSE CAST(1 + o.o_orderkey % 40 AS STRING) END AS minimum_nights,
  CASE WHEN o.o_orderkey % 37 = 1 THEN '2' WHEN o.o_orderkey % 109 = 4 THEN 'n/a'
       ELSE CAST(20 + o.o_orderkey % 400 AS STRING) END AS maximum_nights,
  CASE o.o_orderkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'f' ELSE NULL END AS host_is_superhost,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(3 + o.o_orderkey % 3 AS STRING) END AS review_scores_rating,
  CAST(NULL AS STRING) AS review_scores_accuracy, CAST(NULL AS STRING) AS review_scores_cleanliness,
  CAST(NULL AS STRING) AS review_scores_checkin, CAST(NULL AS STRING) AS review_scores_communication,
  CAST(NULL AS STRING) AS review_scores_location, CAST(NULL AS STRING) AS review_scores_value,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderkey % 5 AS STRING) || '.25' END AS reviews_per_month
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part))"""

RAW_REVIEWS = """raw_reviews AS (
SELECT CAST(l.l_orderkey AS STRING) AS listing_id,
  CAST(l.l_orderkey * 100000 + l.l_partkey AS STRING) || CASE WHEN l.l_partkey % 113 = 3 THEN '.5' ELSE '' END AS id,
  CASE WHEN l.l_partkey % 101 = 0 THEN NULL WHEN l.l_partkey % 103 = 1 THEN '2020-02-30'
       WHEN l.l_partkey % 107 = 2 THEN 'soon' ELSE substr(CAST(l.l_shipdate AS STRING), 1, 10) END AS date,
  CAST(l.l_suppkey AS STRING) AS reviewer_id,
  CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE 'Supplier ' || CAST(l.l_suppkey AS STRING) END AS reviewer_name,
  CASE WHEN l.l_partkey % 37 = 0 THEN NULL ELSE d.text END AS comments
FROM lineitem l JOIN documents d ON d.doc_id = l.l_partkey % (SELECT count(*) FROM documents))"""

_SCORES = ["review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness",
           "review_scores_checkin", "review_scores_communication", "review_scores_location",
           "review_scores_value"]

PARSED = f"""parsed AS (
SELECT {integral('id')} AS id, neighbourhood_cleansed,
  {num('latitude')} AS latitude, {num('longitude')} AS longitude,
  property_type, room_type, {num('accommodates')} AS accommodates,
  {num('bedrooms')} AS bedrooms, {num('beds')} AS beds, {num('bathrooms')} AS bathrooms,
  amenities, TRY_CAST(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE) AS price,
  {num('minimum_nights')} AS minimum_nights, {num('maximum_nights')} AS maximum_nights,
  host_is_superhost,
  {', '.join(num(c) + ' AS ' + c for c in _SCORES)},
  {num('reviews_per_month')} AS reviews_per_month
FROM raw_listings)"""

PREPARED = """prepared AS (SELECT * FROM parsed WHERE price IS NOT NULL)"""

AMENITY_ITEMS = """amenity_items AS (
SELECT id, unnest(CASE WHEN regexp_full_match(t, '(?s)\\s*\\[.*\\]\\s*') AND json_valid(t)
                        THEN from_json(t, '["VARCHAR"]') ELSE []::VARCHAR[] END) AS amenity
FROM (SELECT id, regexp_replace(amenities, ',\\s*\\]\\s*$', ']') AS t FROM prepared))"""

TOP_AMENITIES = """top_amenities AS (
SELECT amenity, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, amenity) AS amenity_rank
FROM amenity_items GROUP BY amenity ORDER BY n DESC, amenity LIMIT 10)"""

ROOM_MEDIANS = """room_medians AS (
SELECT median(beds) AS m_beds, median(bathrooms) AS m_bathrooms, median(bedrooms) AS m_bedrooms FROM prepared)"""

FILLED = """filled AS (
SELECT p.* REPLACE (coalesce(p.beds, m.m_beds) AS beds, coalesce(p.bathrooms, m.m_bathrooms) AS bathrooms,
                    coalesce(p.bedrooms, m.m_bedrooms) AS bedrooms,
                    coalesce(p.host_is_superhost = 't', false) AS host_is_superhost),
       CAST(length(coalesce(p.amenities, '[]')) - length(replace(coalesce(p.amenities, '[]'), ',', '')) + 1 AS BIGINT)
         AS amenities_count
FROM prepared p CROSS JOIN room_medians m)"""

OUTLIERS = """outliers AS (
SELECT * FROM filled
WHERE price BETWEEN 10 AND 2000
  AND price / (CASE WHEN accommodates < 1 THEN 1 ELSE accommodates END) <= 500)"""

FILTERED = """filtered AS (SELECT * FROM outliers WHERE minimum_nights <= 27)"""

PTMAP = """ptmap AS (
SELECT c.property_type,
       CASE WHEN c.n >= CAST(0.01 AS DOUBLE) * t.total THEN c.property_type ELSE 'Other' END AS property_type_slim,
       c.n
FROM (SELECT property_type, count(*) AS n FROM filtered GROUP BY property_type) c
CROSS JOIN (SELECT count(*) AS total FROM filtered) t
WHERE c.property_type IS NOT NULL)"""

CLEAN = """clean AS (
SELECT f.*, coalesce(m.property_type_slim, 'Other') AS property_type_slim
FROM filtered f LEFT JOIN ptmap m ON m.property_type = f.property_type)"""

FLAGS_LONG = """flags_long AS (
SELECT c.id, 'amenity_' || lower(replace(t.amenity, ' ', '_')) AS feature,
       contains(upper(coalesce(c.amenities, '[]')), upper(t.amenity)) AS flag
FROM clean c CROSS JOIN top_amenities t)"""

REVIEWS_CLEAN = f"""reviews_clean AS (
SELECT * FROM (
  SELECT {integral('listing_id')} AS listing_id, {integral('id')} AS id,
         CAST(TRY_STRPTIME(date, '%Y-%m-%d') AS TIMESTAMP) AS date,
         {integral('reviewer_id')} AS reviewer_id,
         coalesce(reviewer_name, 'Unknown') AS reviewer_name, coalesce(comments, '') AS comments
  FROM raw_reviews) r
WHERE listing_id IS NOT NULL AND id IS NOT NULL AND date IS NOT NULL)"""

SUMMARY = """summary AS (
SELECT s.*, CAST(date_diff('day', s.last_review, l.latest) AS BIGINT) AS days_since_last_review
FROM (SELECT listing_id, count(id) AS n_reviews, min(date) AS first_review, max(date) AS last_review,
             avg(length(comments)) AS avg_comment_length
      FROM reviews_clean GROUP BY listing_id) s
CROSS JOIN (SELECT max(date) AS latest FROM reviews_clean) l)"""

JOINED = """joined AS (
SELECT l.*, s.listing_id, s.n_reviews, s.first_review, s.last_review, s.avg_comment_length, s.days_since_last_review
FROM clean l LEFT JOIN summary s ON s.listing_id = l.id)"""

HAV = """(12742.0 * asin(CASE WHEN sqrt({a}) > 1.0 THEN 1.0 ELSE sqrt({a}) END))"""


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2.0), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin((radians({lon2}) - radians({lon1})) / 2.0), 2))")
    return HAV.format(a=a)


FEATURES = f"""features AS (
SELECT j.* EXCLUDE (amenities) REPLACE (
         CASE WHEN j.host_is_superhost THEN 1 ELSE 0 END AS host_is_superhost,
         coalesce(j.review_scores_rating, st.m_rating) AS review_scores_rating,
         coalesce(j.reviews_per_month, 0.0) AS reviews_per_month,
         coalesce(j.avg_comment_length, 0.0) AS avg_comment_length,
         coalesce(j.days_since_last_review, st.max_days) AS days_since_last_review),
       {haversine('j.longitude', 'j.latitude', '2.3522', '48.8566')} AS dist_to_center_km,
       j.price / (CASE WHEN j.accommodates = 0 THEN 1 ELSE j.accommodates END) AS price_per_person
FROM joined j CROSS JOIN (SELECT median(review_scores_rating) AS m_rating, max(days_since_last_review) AS max_days
                          FROM joined) st)"""

# Key hash H(id) = first 8 hex digits of md5('<id>:42') as BIGINT.
def key_hash(x: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5(concat(CAST({x} AS STRING), ':{seed}')), 1, 8)) AS BIGINT)"


FOLDS = f"""folds AS (
SELECT f.*, {key_hash('f.id')} % 5 AS fold FROM features f)"""

# OOF target encoding of neighbourhood_cleansed over the 5 folds.
OOF_TE = """oof_te AS (
SELECT f.id, f.fold, f.neighbourhood_cleansed, f.price,
       coalesce((cs.s - coalesce(cf.s, 0)) / NULLIF(cs.n - coalesce(cf.n, 0), 0), g.mean_price) AS neighbourhood_te
FROM folds f
CROSS JOIN (SELECT avg(price) AS mean_price FROM folds) g
LEFT JOIN (SELECT neighbourhood_cleansed, sum(price) AS s, count(*) AS n FROM folds GROUP BY 1) cs
       ON cs.neighbourhood_cleansed = f.neighbourhood_cleansed
LEFT JOIN (SELECT neighbourhood_cleansed, fold, sum(price) AS s, count(*) AS n FROM folds GROUP BY 1, 2) cf
       ON cf.neighbourhood_cleansed = f.neighbourhood_cleansed AND cf.fold = f.fold)"""

BLOCKS = {
    "raw_listings": (RAW_LISTINGS, ()),
    "raw_reviews": (RAW_REVIEWS, ()),
    "parsed": (PARSED, ("raw_listings",)),
    "prepared": (PREPARED, ("parsed",)),
    "amenity_items": (AMENITY_ITEMS, ("prepared",)),
    "top_amenities": (TOP_AMENITIES, ("amenity_items",)),
    "room_medians": (ROOM_MEDIANS, ("prepared",)),
    "filled": (FILLED, ("prepared", "room_medians")),
    "outliers": (OUTLIERS, ("filled",)),
    "filtered": (FILTERED, ("outliers",)),
    "ptmap": (PTMAP, ("filtered",)),
    "clean": (CLEAN, ("filtered", "ptmap")),
    "flags_long": (FLAGS_LONG, ("clean", "top_amenities")),
    "reviews_clean": (REVIEWS_CLEAN, ("raw_reviews",)),
    "summary": (SUMMARY, ("reviews_clean",)),
    "joined": (JOINED, ("clean", "summary")),
    "features": (FEATURES, ("joined",)),
    "folds": (FOLDS, ("features",)),
    "oof_te": (OOF_TE, ("folds",)),
}


def with_blocks(*needed: str, extra: list[str] | None = None) -> str:
    """WITH clause holding ``needed`` blocks and their dependencies, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in BLOCKS[name][1]:
            visit(dep)
        order.append(name)

    for name in needed:
        visit(name)
    parts = [BLOCKS[n][0] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n"

# --- splits, strata, encodings ---------------------------------------------
HOLDOUT = f"""holdout AS (
SELECT f.*, ({key_hash('f.id')} < 0.1 * 4294967296) AS is_holdout FROM features f)"""

STRATA = """strata AS (
SELECT f.*, CAST(len(list_filter(list_distinct(e.qs), lambda x: x > e.mn AND x < f.price)) AS INTEGER) AS stratum
FROM features f CROSS JOIN (
  SELECT min(price) AS mn, quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM features) e)"""

# Largest-remainder shares of the rows that are not held out, in whole numbers.
QUOTAS = """quotas AS (
SELECT stratum, n - base - CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= kept - sum(base) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT *, CAST(n AS HUGEINT) * kept // total AS base, CAST(n AS HUGEINT) * kept % total AS rest
      FROM (SELECT stratum, n, sum(n) OVER () AS total, sum(n) OVER () - CAST(ceil(0.2 * sum(n) OVER ()) AS BIGINT) AS kept
            FROM (SELECT stratum, count(*) AS n FROM strata GROUP BY 1))))"""

SPLIT = f"""split AS (
SELECT s.* EXCLUDE (rk, quota), rk <= quota AS is_test FROM (
  SELECT st.*, q.quota, row_number() OVER (PARTITION BY st.stratum ORDER BY {key_hash('st.id')}, st.id) AS rk
  FROM strata st JOIN quotas q ON q.stratum = st.stratum) s)"""

TRAIN = """train AS (SELECT * FROM split WHERE NOT is_test)"""
TEST = """test AS (SELECT * FROM split WHERE is_test)"""

BLOCKS.update({
    "holdout": (HOLDOUT, ("features",)),
    "strata": (STRATA, ("features",)),
    "quotas": (QUOTAS, ("strata",)),
    "split": (SPLIT, ("strata", "quotas")),
    "train": (TRAIN, ("split",)),
    "test": (TEST, ("split",)),
})
