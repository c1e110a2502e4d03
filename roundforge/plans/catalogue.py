"""The catalogue: queries over the test tables, each with equivalent SQL where SQL can express it.

``query`` registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundforge.functions import hashing, text
from roundforge.operators import assets, build, curation, game, quality, rerank, screening, sharding, validate, workspace
from roundforge.operators.signature import signatures
from roundforge.plans import sqltext as q
from roundforge.plans import views
from roundforge.plans.views import table, with_views
from roundforge.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 1337
DATE = "2026-09-18"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


# --- joins and aggregates ----------------------------------------------------------------------


@query(with_views("products reviews", "SELECT category, count(*) AS reviews, round(avg(rating), 6) AS mean_rating, count(*) FILTER (verified_purchase) AS verified, sum(helpful_vote)::BIGINT AS votes FROM reviews JOIN products USING (parent_asin) GROUP BY category"))
def q_reviews_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01, AGG-01: reviews joined with their products, by category. Reviews are counted by parent before the join."""
    r = views.reviews(spark, sf_dir).groupBy("parent_asin").agg(F.count("*").alias("n"), F.sum("rating").alias("s"), F.count_if("verified_purchase").alias("v"), F.sum("helpful_vote").alias("h"))
    p = views.products(spark, sf_dir).select("parent_asin", "category")
    return r.join(p, "parent_asin").groupBy("category").agg(F.sum("n").alias("reviews"), r6(F.sum("s") / F.sum("n")).alias("mean_rating"), F.sum("v").alias("verified"), F.sum("h").alias("votes"))


@query(with_views("products reviews", "SELECT parent_asin, title FROM products p WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.parent_asin = p.parent_asin AND rating >= 5 AND helpful_vote >= 45)"))
def q_semi_wanted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02, FLT-01."""
    wanted = views.reviews(spark, sf_dir).filter("rating >= 5 and helpful_vote >= 45")
    return build.wanted_products(views.products(spark, sf_dir), wanted).select("parent_asin", "title")


@query(with_views("products reviews", "SELECT parent_asin, title FROM products p WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.parent_asin = p.parent_asin AND rating >= 5 AND helpful_vote >= 45)"))
def q_anti_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08's kind: an anti join."""
    wanted = views.reviews(spark, sf_dir).filter("rating >= 5 and helpful_vote >= 45")
    return build.without_reviews(views.products(spark, sf_dir), wanted).select("parent_asin", "title")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def q_last_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: the last row of each key."""
    e = table(spark, sf_dir, "events").withColumn("pos", F.struct("ts", "event_id"))
    return build.last_by(e.select("user_id", "event_id", "event_type", "pos"), "user_id").select("user_id", "event_id", "event_type")


@query("SELECT lower(p_name) AS title_key, min(p_partkey) AS pos, arg_min(p_name, p_partkey) AS title FROM part GROUP BY 1")
def q_first_wins_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: the first spelling of each name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))
    return build.first_by(p, F.lower("title")).select(F.lower("title").alias("title_key"), "pos", "title")


@query(with_views("products", f"SELECT parent_asin, array_to_string(list_sort({q.tokens('title')}), ' ') AS tokens, len({q.build_tokens('title')})::INT AS build_tokens FROM products"))
def q_title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-01, SCL-02."""
    p = views.products(spark, sf_dir)
    return p.select("parent_asin", F.array_join(F.array_sort(text.tokens(F.col("title"))), " ").alias("tokens"), F.size(text.tokens(F.col("title"), text.BUILD_STOP)).alias("build_tokens"))


@query(with_views("products", f"SELECT a.parent_asin, round({q.jaccard('a.t', 'b.t')}, 6) AS jaccard, round({q.cosine('a.t', 'b.t')}, 6) AS cosine, {q.shared('a.t', 'b.t')}::INT AS shared, round(14.0 * ({q.jaccard('a.t', 'b.t')}) + 4.0 * ({q.cosine('a.t', 'b.t')}) + 0.2 * least({q.shared('a.t', 'b.t')}, 4), 6)::DOUBLE AS score FROM t a JOIN t b ON b.pos = a.pos + 1", f"t AS (SELECT pos, parent_asin, {q.tokens('title')} AS t FROM products)"))
def q_title_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-03 to SCL-05: each product and the next one."""
    t = views.products(spark, sf_dir).select("pos", "parent_asin", text.tokens(F.col("title")).alias("t"))
    n = t.select((F.col("pos") - 1).alias("pos"), F.col("t").alias("u"))
    a, b = F.col("t"), F.col("u")
    return t.join(n, "pos").select("parent_asin", r6(text.jaccard(a, b)).alias("jaccard"), r6(text.cosine(a, b)).alias("cosine"), text.shared_tokens(a, b).alias("shared"), r6(text.rerank_score(a, b)).alias("score"))


@query(with_views("products", "SELECT a.parent_asin, (CASE WHEN lower(a.category) <> lower(b.category) THEN 0 WHEN lower(a.leaf_category) <> lower(b.leaf_category) THEN 1 ELSE 2 END + CASE WHEN lower(a.leaf_category) = lower(b.leaf_category) THEN 4 WHEN lower(a.category) = lower(b.category) THEN 2 ELSE 0 END)::INT AS taxonomy FROM products a JOIN products b ON b.pos = a.pos + 6"))
def q_taxonomy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-07: each product and the sixth after it."""
    p = views.products(spark, sf_dir).select("pos", "parent_asin", "category_path", "leaf_category", "category")
    o = p.select((F.col("pos") - 6).alias("pos"), *[F.col(c).alias(f"o_{c}") for c in ("category_path", "leaf_category", "category")])
    c = F.col
    return p.join(o, "pos").select("parent_asin", text.taxonomy_score(c("category_path"), c("leaf_category"), c("category"), c("o_category_path"), c("o_leaf_category"), c("o_category")).alias("taxonomy"))


_THETA = f"""pool AS (SELECT DISTINCT category, leaf_category, title, {q.build_tokens('title')} AS t FROM products),
pool1 AS (SELECT category, title, arg_min(leaf_category, leaf_category) AS leaf_category, arg_min(t, leaf_category) AS t FROM pool GROUP BY category, title),
pairs AS (SELECT p.parent_asin, o.title AS distractor, {q.jaccard('p.t', 'o.t')} AS s, CASE WHEN p.leaf_category = o.leaf_category THEN 6 ELSE 3 END AS tax
 FROM (SELECT *, {q.build_tokens('title')} AS t FROM products) p JOIN pool1 o ON o.category = p.category AND lower(o.title) <> lower(p.title)),
ranked AS (SELECT parent_asin, distractor, round(tax + 2.0 * least(s, 0.45), 6)::DOUBLE AS rank_score, row_number() OVER (PARTITION BY parent_asin ORDER BY round(tax + 2.0 * least(s, 0.45), 6) DESC, distractor) AS rank FROM pairs WHERE s < 0.72)"""


@query(with_views("products", "SELECT parent_asin, rank::INT AS rank, distractor, rank_score FROM ranked WHERE rank <= 3", _THETA))
def q_theta_topk_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03, SRT-02, FLT-04: the three most plausible other titles."""
    p = views.products(spark, sf_dir)
    return build.theta_distractors(p, p)


_BANK = """offered AS (SELECT CASE WHEN source_category = '' THEN 'Other' ELSE source_category END AS category, pos AS round_pos, unnest(list_concat(choices, [title])) AS raw, generate_subscripts(list_concat(choices, [title]), 1) - 1 AS place FROM rounds),
bank AS (SELECT category, lower(trim(raw)) AS key, arg_min(trim(raw), (round_pos, place)) AS title FROM offered GROUP BY 1, 2)"""


@query(with_views("rounds", "SELECT category, key, title FROM bank", _BANK))
def q_choice_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    return rerank.candidate_bank(views.rounds(spark, sf_dir)).select("category", "key", "title")


_RERANK = _BANK + f""",
own AS (SELECT id, CASE WHEN source_category = '' THEN 'Other' ELSE source_category END AS category, lower(trim(title)) AS own_key, {q.tokens('title')} AS own FROM rounds),
titles AS (SELECT category, key, title, {q.tokens('title')} AS other FROM bank),
pairs AS (SELECT id, t.title, {q.jaccard('own', 'other')} AS j, {q.cosine('own', 'other')} AS c, {q.shared('own', 'other')} AS s FROM own JOIN titles t USING (category) WHERE key <> own_key),
scored AS (SELECT id, title, round(14.0 * j + 4.0 * c + 0.2 * least(s, 4), 6)::DOUBLE AS score, round(j, 6) AS jaccard FROM pairs WHERE j < 0.62),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, title) AS rank FROM scored)"""


@query(with_views("rounds", "SELECT id, rank::INT AS rank, title, score, jaccard FROM ranked WHERE rank <= 3", _RERANK))
def q_rerank_top3_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-04, SRT-03."""
    r = views.rounds(spark, sf_dir)
    return rerank.top_distractors(r, rerank.candidate_bank(r))


@query(with_views("rounds", "SELECT id, array_to_string(list_sort(list_append(list(ranked.title), any_value(r.title))), '|') AS choices FROM ranked JOIN rounds r USING (id) WHERE rank <= 3 GROUP BY id HAVING count(*) = 3", _RERANK))
def q_rewritten_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05, SRT-09: choices after reranking, of rounds with three distractors; rounds that found fewer look everywhere."""
    r = views.rounds(spark, sf_dir)
    bank = rerank.candidate_bank(r)
    found = rerank.fallback(r, bank, rerank.top_distractors(r, bank))
    return rerank.rewrite_choices(r, found).select("id", F.array_join("choices", "|").alias("choices"))


_LEAK = f"""pairs AS (SELECT doc_id, item_id, {q.tokens('b.text')} AS own, {q.tokens("'' || ' ' || d.text")} AS said FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""


@query(with_views("", "SELECT doc_id, round(CASE WHEN len(own) > 0 THEN len(list_intersect(own, said))::DOUBLE / len(own) ELSE 0.0::DOUBLE END, 6) AS leak FROM pairs", "").replace("SELECT doc_id, round", "WITH " + _LEAK + " SELECT doc_id, round", 1))
def q_leak_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-08, JN-15: how much of a benchmark item's words a document has."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"))
    items = F.broadcast(b.agg(F.count("*").alias("items")))  # one row
    return d.join(items).join(b, F.col("doc_id") % F.col("items") == F.col("item_id")).select("doc_id", r6(text.leak_ratio(F.col("title"), F.lit(""), F.col("text"))).alias("leak"))


# --- scores and audits -------------------------------------------------------------------------

_SCORED = f"""s1 AS (SELECT *, {q.tokens('title')} AS tt, {q.tokens("review_title || ' ' || coalesce(review_text, '')")} AS rt FROM rounds),
s2 AS (SELECT *, list_transform(list_filter(choices, lambda c: c <> title), lambda c: {q.jaccard('tt', q.tokens('c'))}) AS sims,
 CASE WHEN len(tt) > 0 THEN len(list_intersect(tt, rt))::DOUBLE / len(tt) ELSE 0.0::DOUBLE END AS leak,
 CASE WHEN review_image IS NULL THEN 'missing' WHEN review_image LIKE 'https://%' THEN lower(split_part(split_part(review_image, '://', 2), '/', 1)) WHEN review_image LIKE 'assets/%' THEN 'local' ELSE 'unknown' END AS host FROM s1),
s3 AS (SELECT *, coalesce(list_max(sims), 0.0::DOUBLE) AS mx, CASE WHEN len(sims) > 0 THEN list_sum(sims) / len(sims) ELSE 0.0::DOUBLE END AS mean, length(trim(coalesce(review_text, ''), E' \\t\\n\\r')) AS said,
 len(list_distinct(list_transform(choices, lambda c: trim(lower(c))))) AS nd FROM s2),
s4 AS (SELECT *, list_filter([
 CASE WHEN said = 0 THEN {{'n': 'missing_review_text', 'w': 8}} WHEN said < 35 THEN {{'n': 'very_short_review_text', 'w': 4}} END,
 CASE WHEN length(title) > 170 THEN {{'n': 'very_long_product_title', 'w': 10}} WHEN length(title) > 120 THEN {{'n': 'long_product_title', 'w': 5}} END,
 CASE WHEN mx >= 0.65 THEN {{'n': 'near_duplicate_answer_title', 'w': 30}} WHEN mx >= 0.45 THEN {{'n': 'high_answer_title_similarity', 'w': 14}} END,
 CASE WHEN len(sims) > 0 AND mx <= 0.03 THEN {{'n': 'very_dissimilar_answer_titles', 'w': 8}} END,
 CASE WHEN leak >= 0.75 AND len(tt) >= 2 THEN {{'n': 'review_strongly_reveals_product_title', 'w': 28}} WHEN leak >= 0.5 AND len(tt) >= 2 THEN {{'n': 'review_may_reveal_product_title', 'w': 14}} END,
 CASE WHEN rating IS NULL THEN {{'n': 'missing_rating', 'w': 2}} END, CASE WHEN source_url IS NULL THEN {{'n': 'missing_product_source', 'w': 2}} END,
 CASE WHEN host IN ('missing', 'unknown') THEN {{'n': 'unusual_image_reference', 'w': 18}} END,
 CASE WHEN len(choices) <> 4 THEN {{'n': 'wrong_choice_count', 'w': 40}} WHEN nd <> 4 THEN {{'n': 'duplicate_choices', 'w': 45}} END], lambda x: x IS NOT NULL) AS fl FROM s3),
scored AS (SELECT *, round_even(100 * least(1.0, 0.78 * mx + 0.22 * mean), 0)::INT AS difficulty, least(100, coalesce(list_sum(list_transform(fl, lambda f: f.w)), 0))::INT AS priority, list_transform(fl, lambda f: f.n) AS flags FROM s4)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.analyze(views.rounds(spark, sf_dir))


@query(with_views("rounds", "SELECT id, difficulty, priority, array_to_string(flags, ',') AS flags, round_even(mx, 4) AS sim_max, round_even(mean, 4) AS sim_mean, round_even(leak, 4) AS leak, host FROM scored", _SCORED))
def q_round_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-09, SCL-10, PRJ-13, PRJ-21, AGG-09."""
    a = F.col("analysis")
    return _scored(spark, sf_dir).select("id", a["difficulty_score"].alias("difficulty"), a["curation_priority"].alias("priority"), F.array_join(a["flags"], ",").alias("flags"), a["choice_similarity_max"].alias("sim_max"), a["choice_similarity_mean"].alias("sim_mean"), a["review_title_leak_ratio"].alias("leak"), a["image_host"].alias("host"))


_BUCKETS = "CASE WHEN difficulty < 20 THEN 'very easy' WHEN difficulty < 40 THEN 'easy' WHEN difficulty < 60 THEN 'medium' WHEN difficulty < 80 THEN 'hard' ELSE 'very hard' END"


@query(with_views("rounds", f"""SELECT facet, key, count(*) AS n FROM (SELECT 'category' AS facet, CASE WHEN source_category = '' THEN 'Other' ELSE source_category END AS key FROM scored
 UNION ALL SELECT 'rating', coalesce(trunc(rating)::INT::VARCHAR, 'missing') FROM scored UNION ALL SELECT 'host', host FROM scored UNION ALL SELECT 'difficulty', {_BUCKETS} FROM scored
 UNION ALL SELECT 'priority', CASE WHEN priority >= 40 THEN 'high' WHEN priority >= 15 THEN 'medium' ELSE 'low' END FROM scored UNION ALL SELECT 'flag', unnest(flags) FROM scored) GROUP BY facet, key""", _SCORED))
def q_audit_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01 to AGG-04."""
    return quality.audit(_scored(spark, sf_dir))


@query(with_views("rounds", "SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM scored) GROUP BY flag", _SCORED))
def q_audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, SRT-06: flags, most frequent first."""
    return quality.flag_counts(_scored(spark, sf_dir))


@query(with_views("rounds", "SELECT count(*) AS rounds, coalesce(round_even(avg(difficulty), 1), 0) AS mean_difficulty, coalesce(round_even(avg(priority), 1), 0) AS mean_priority, count(*) FILTER (verified_purchase) AS verified, count(*) FILTER (helpful_vote > 0) AS helpful FROM scored", _SCORED))
def q_audit_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, AGG-06."""
    return quality.averages(_scored(spark, sf_dir))


# --- screening ---------------------------------------------------------------------------------

_SCREENED = r"""blob AS (SELECT id, concat_ws(chr(10), CASE WHEN trim(review_title) <> '' THEN review_title END, CASE WHEN trim(review_text) <> '' THEN review_text END) AS t FROM texts),
hits AS (SELECT id, regexp_matches(t, '(?i)(^|[^\pL\pN_.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}($|[^\pL\pN_-])') AS email,
 regexp_matches(t, '(^|[^0-9])(\+?1[ .-]?)?(\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}($|[^0-9])') AS phone,
 regexp_matches(t, '(?i)(^|[^\pL\pN_])(https?://|www\.)[^\s<>()]+') AS url,
 regexp_matches(t, '(^|[^\pL\pN_@])@[A-Za-z0-9_][A-Za-z0-9_.-]{2,30}($|[^\pL\pN_@])') AS social,
 regexp_matches(t, '(^|[^0-9])[-+]?([0-8]?[0-9](\.[0-9]+)?|90(\.0+)?)\s*,\s*[-+]?(1[0-7][0-9](\.[0-9]+)?|180(\.0+)?|[0-9]?[0-9](\.[0-9]+)?)($|[^0-9])') AS coords FROM blob),
screened AS (SELECT *, least(100, email::INT * 50 + phone::INT * 50 + url::INT * 20 + social::INT * 20 + coords::INT * 50)::INT AS risk, email OR phone OR url OR social OR coords AS needs_review, email OR phone OR coords AS high_risk,
 list_filter([CASE WHEN email THEN 'contact_email' END, CASE WHEN phone THEN 'contact_phone' END, CASE WHEN url THEN 'external_url' END, CASE WHEN social THEN 'social_handle' END, CASE WHEN coords THEN 'possible_coordinates' END], lambda x: x IS NOT NULL) AS flags FROM hits)"""


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(views.texts(spark, sf_dir))


@query(with_views("texts", "SELECT id, risk, needs_review, high_risk, array_to_string(flags, ',') AS flags FROM screened", _SCREENED))
def q_screen_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-11, SCL-15, AGG-08."""
    s = F.col("screening")
    return _screened(spark, sf_dir).select("id", s["risk_score"].alias("risk"), s["needs_review"].alias("needs_review"), s["high_risk"].alias("high_risk"), F.array_join(F.transform(s["flags"], lambda f: f["name"]), ",").alias("flags"))


@query(with_views("texts", """SELECT measure, key, count(*) AS n FROM (SELECT 'total' AS measure, 'rounds' AS key FROM screened UNION ALL SELECT 'total', 'needs_review' FROM screened WHERE needs_review
 UNION ALL SELECT 'total', 'high_risk' FROM screened WHERE high_risk UNION ALL SELECT 'flag', unnest(flags) FROM screened
 UNION ALL SELECT 'severity', CASE WHEN f IN ('external_url', 'social_handle') THEN 'medium' ELSE 'high' END FROM (SELECT unnest(flags) AS f FROM screened)) GROUP BY measure, key""", _SCREENED))
def q_screen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07."""
    return screening.roll_up(_screened(spark, sf_dir))


@query(with_views("texts", "SELECT id, risk FROM screened WHERE NOT high_risk", _SCREENED))
def q_exclude_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05."""
    return screening.exclude_high(_screened(spark, sf_dir)).select("id", F.col("screening.risk_score").alias("risk"))


# --- sampling and order ------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events ORDER BY sha256('1337|' || event_id::VARCHAR), event_id LIMIT 300")
def q_sample_hash_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01: a sampling operator, so the limit is the feature."""
    return build.sample(table(spark, sf_dir, "events").select("event_id", "user_id"), 300, SEED, "event_id")


@query(with_views("rounds", "SELECT category, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY sha256('1337|' || id), id) AS n FROM rounds) WHERE n <= 25"))
def q_per_category_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06."""
    return build.per_group_limit(views.rounds(spark, sf_dir).select("category", "id"), "category", 25, [hashing.keyed(SEED, F.col("id")), "id"])


@query(with_views("rounds", "SELECT id, parent_asin FROM (SELECT *, row_number() OVER (PARTITION BY category, leaf_category ORDER BY pos) AS n FROM rounds) WHERE n = 1"))
def q_distinct_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: the first round of each key."""
    r = views.rounds(spark, sf_dir)
    return build.first_by(r, F.struct("category", "leaf_category")).select("id", "parent_asin")


def _two_key(reviews: DataFrame) -> DataFrame:
    r = reviews.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("copies"))
    keyed = r.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("key"), F.col("l_orderkey").alias("image"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("parent"))
    ordered = keyed.withColumn("pos", F.pmod(F.xxhash64("key"), F.lit(1 << 62)))
    return build.greedy_two_key(ordered, "image", "parent", "pos").select("key", "image", "parent")


@query()
def q_greedy_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: all reviews in order, each kept if neither its order nor its part and supplier were kept before. Tested against a plain loop."""
    return _two_key(views.reviews(spark, sf_dir))


# --- hashes ------------------------------------------------------------------------------------


@query(with_views("rounds", f"SELECT id, substr(sha256(parent_asin), 1, 24) AS asset, ({q.fnv('parent_asin')})::BIGINT AS fnv FROM rounds"))
def q_sha_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-18, SCL-19."""
    return views.rounds(spark, sf_dir).select("id", hashing.asset_id(F.col("parent_asin").cast("binary")).alias("asset"), hashing.fnv1a(F.col("parent_asin")).alias("fnv"))


@query(with_views("rounds", f"SELECT category, printf('%x', {q.fnv('ids')}) AS signature FROM (SELECT category, string_agg(id, '|' ORDER BY id) AS ids FROM rounds GROUP BY category)"))
def q_fnv_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: the signature of each category's rounds."""
    return signatures(views.rounds(spark, sf_dir).select("category", "id"), "id", "category")


@query(with_views("rounds", f"SELECT printf('%x', {q.fnv('ids')}) AS signature FROM (SELECT string_agg(id, '|' ORDER BY id) AS ids FROM rounds)"))
def q_fnv_signature_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: the signature of all rounds, in parts of 500 ids that are folded at once and joined."""
    return signatures(views.rounds(spark, sf_dir).select("id"), "id", part_ids=500)


# --- shards ------------------------------------------------------------------------------------

_SHARDED = """sharded AS (SELECT *, row_number() OVER (ORDER BY sha256('7|' || id), id) - 1 AS place, count(*) OVER () AS total FROM rounds),
shards AS (SELECT *, lpad((place // 250 + 1)::VARCHAR, greatest(4, length(ceil(total / 250.0)::BIGINT::VARCHAR))::INT, '0') AS shard, CASE WHEN trim(source_category) <> '' THEN trim(source_category) ELSE category END AS cat FROM sharded)"""


@query(with_views("rounds", "SELECT id, place::BIGINT AS place, shard FROM shards", _SHARDED))
def q_shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09."""
    return sharding.assign(views.rounds(spark, sf_dir), 250, 7).select("id", "place", "shard")


@query(with_views("rounds", "SELECT shard, sum(n)::BIGINT AS round_count, string_agg(cat || ':' || n::VARCHAR, ',' ORDER BY cat) AS categories FROM (SELECT shard, cat, count(*) AS n FROM shards GROUP BY shard, cat) GROUP BY shard", _SHARDED))
def q_shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, PRJ-12."""
    c = sharding.category_counts(sharding.assign(views.rounds(spark, sf_dir), 250, 7), "shard")
    return c.select("shard", "round_count", F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("categories"))


@query(with_views("rounds", """SELECT 'shard differs' AS error, id FROM shards WHERE pos % 40 = 0 AND pos % 90 <> 0 UNION ALL SELECT 'not in the index', id FROM shards WHERE pos % 90 = 0
 UNION ALL SELECT 'not in any shard', 'z' || id FROM shards WHERE pos % 70 = 0 UNION ALL SELECT 'unknown shard', id FROM shards WHERE pos % 40 = 0 AND pos % 90 <> 0""", _SHARDED))
def q_shard_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10, JN-11, VAL-02: an index with planted faults against the shards."""
    r = sharding.assign(views.rounds(spark, sf_dir), 250, 7).select("id", "pos", "category", "shard")
    own = r.filter("pos % 90 <> 0").withColumn("shard", F.when(F.col("pos") % 40 == 0, "none").otherwise(F.col("shard")))
    lost = r.filter("pos % 70 = 0").withColumn("id", F.concat(F.lit("z"), "id"))
    index = own.union(lost).select("id", "category", "shard")
    return sharding.index_errors(index, r, r.select(F.col("shard").alias("id")).distinct())


@query(with_views("rounds", "SELECT id, CASE WHEN trim(source_category) <> '' THEN trim(source_category) ELSE category END AS category, priority::DOUBLE AS priority, difficulty::DOUBLE AS difficulty FROM scored", _SCORED))
def q_manifest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-17, SCL-31, SCL-32."""
    s = screening.screen(_scored(spark, sf_dir)).withColumn("shard", F.lit("0001"))
    return sharding.index(s).select("id", "category", F.col("analysis.curation_priority").alias("priority"), F.col("analysis.difficulty_score").alias("difficulty"))


@query(with_views("rounds", "SELECT pos, id, title FROM rounds WHERE pos % 3 = 0 ORDER BY pos"))
def q_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13, SRC-09: requested rounds in request order."""
    r = sharding.assign(views.rounds(spark, sf_dir), 250, 7)
    wanted = r.filter("pos % 3 = 0").select("pos", "id")
    return sharding.lookup(wanted, r.select("id", "shard"), r.select("id", "shard", "title")).select("pos", "id", "title")


# --- game --------------------------------------------------------------------------------------


@query(with_views("rounds", f"SELECT id, ({q.fnv(repr(f'daily:{DATE}|') + ' || id')})::BIGINT AS rank FROM rounds ORDER BY rank, pos LIMIT 5"))
def q_daily_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10, WIN-11: the day's five rounds, a top-k."""
    return game.daily_rounds(views.rounds(spark, sf_dir), DATE).select("id", "rank")


@query(with_views("rounds", f"""SELECT id, string_agg(c, '|' ORDER BY k, i) AS choices FROM (SELECT id, i, c, {q.fnv("s || c")} AS k FROM (SELECT id, generate_subscripts(choices, 1) AS i, unnest(choices) AS c, 'choices:{DATE}:' || id || '|' AS s FROM rounds)) GROUP BY id"""))
def q_stable_rank_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: the day's order of choices."""
    return views.rounds(spark, sf_dir).select("id", F.array_join(game.daily_choices(F.col("choices"), DATE, F.col("id")), "|").alias("choices"))


@query(with_views("rounds", "SELECT id FROM rounds WHERE review_image IS NOT NULL AND len(choices) >= 2"))
def q_playable_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11."""
    return game.playable(views.rounds(spark, sf_dir)).select("id")


@query(with_views("rounds", "SELECT id FROM rounds WHERE category = (SELECT min(category) FROM rounds) ORDER BY sha256('1337|' || id), id LIMIT 20"))
def q_random_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05, FLT-13: a sample of 20 rounds of a category."""
    r = views.rounds(spark, sf_dir)
    first = r.agg(F.min("category")).first()[0]
    return game.random_game(r, "20", SEED, first).select("id")


_STREAK = """answers AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'correct' WHEN event_type = 'error' THEN 'skipped' ELSE 'wrong' END AS outcome FROM events),
i AS (SELECT *, sum(CASE WHEN outcome = 'correct' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM answers),
s AS (SELECT *, CASE WHEN outcome = 'correct' THEN sum(CASE WHEN outcome = 'correct' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM i),
p AS (SELECT *, CASE WHEN outcome = 'correct' THEN 100 + least(streak - 1, 5) * 20 ELSE 0 END AS points FROM s)"""


@query("WITH " + _STREAK + " SELECT event_id, outcome, streak::BIGINT AS streak, points::BIGINT AS points, (sum(points) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS score FROM p")
def q_streak_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12."""
    return game.streak_scores(ev.outcomes(table(spark, sf_dir, "events")), order=("ts", "event_id")).select("event_id", "outcome", "streak", "points", "score")


@query("WITH " + _STREAK + """ SELECT user_id, count(*) AS answers, count(*) FILTER (outcome = 'correct') AS correct, sum(points)::BIGINT AS score, max(streak)::BIGINT AS best_streak,
 CASE WHEN count(*) FILTER (outcome = 'correct') = count(*) THEN 'perfect' WHEN count(*) FILTER (outcome = 'correct') >= 0.75 * count(*) THEN 'great' WHEN count(*) FILTER (outcome = 'correct') >= 0.5 * count(*) THEN 'solid' ELSE 'weird' END AS headline FROM p GROUP BY user_id""")
def q_game_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19."""
    return game.results(game.streak_scores(ev.outcomes(table(spark, sf_dir, "events")), order=("ts", "event_id")))


# --- curation ----------------------------------------------------------------------------------

_Q = """docq AS (SELECT d.doc_id AS pos, 'd' || d.doc_id::VARCHAR AS id, d.lang AS category, CASE WHEN l.quality = 0 THEN 'reject' WHEN l.toxic = 1 THEN 'keep' END AS decision, d.n_chars % 101 AS priority, d.doc_id * 29 % 101 AS difficulty, d.doc_id % 4 <> 3 AS screened, d.doc_id % 10 = 0 AS hi, d.doc_id % 3 = 0 AS mid,
 (CASE WHEN d.doc_id % 10 = 0 THEN 50 ELSE 0 END + CASE WHEN d.doc_id % 3 = 0 THEN 20 ELSE 0 END) AS risk FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rounds to curate: labels decide some of them, numbers give closed-form scores and flags."""
    k = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "reject").when(F.col("toxic") == 1, "keep").alias("decision"))
    flags = F.array_compact(F.array(F.when(k % 10 == 0, screening.flag("contact_email", "high", "review_text")), F.when(k % 3 == 0, screening.flag("possible_face", "medium", "image"))))
    analysis = F.struct((F.col("n_chars") % 101).cast("int").alias("curation_priority"), (k * 29 % 101).cast("int").alias("difficulty_score"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(k.alias("pos"), F.concat(F.lit("d"), k.cast("string")).alias("id"), F.col("lang").alias("category"), "decision", analysis.alias("analysis"), F.when(k % 4 != 3, screening.summary_of(flags)).alias("screening"), F.array(F.concat(F.lit("Tag"), (k % 5).cast("string"))).alias("tags"))


for _sort, _key in {"priority": "priority", "screening": "CASE WHEN screened THEN risk ELSE -1 END", "hardest": "difficulty", "easiest": "difficulty", "dataset": "pos"}.items():

    def _make(sort: str, key: str) -> None:
        def f(spark: SparkSession, sf_dir: str) -> DataFrame:
            """SRT-01, FLT-07 to FLT-11, WIN-13: undecided English rounds to review, in order, with the key they are sorted by."""
            rows = curation.queue(_queue(spark, sf_dir), category="en", status="undecided", screening="review", signal="possible_face", tag="tag2", sort=sort)
            keys = {"priority": "analysis.curation_priority", "screening": "screening.risk_score", "dataset": "pos"}
            return rows.select("id", F.col(keys.get(sort, "analysis.difficulty_score")).cast("long").alias("sort_key"))

        f.__name__ = f"q_curator_queue_{sort}"
        query(f"WITH {_Q} SELECT id, ({key})::BIGINT AS sort_key FROM docq WHERE category = 'en' AND decision IS NULL AND screened AND mid AND pos % 5 = 2 ORDER BY sort_key, pos")(f)

    _make(_sort, _key)


@query(f"WITH {_Q} SELECT 'reject-high' AS action, id FROM docq WHERE decision IS NULL AND screened AND hi UNION ALL SELECT 'keep-clear', id FROM docq WHERE decision IS NULL AND screened AND NOT hi AND NOT mid AND priority <= 20")
def q_bulk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, FLT-09."""
    r = _queue(spark, sf_dir)
    return curation.bulk_candidates(r, "reject-high").select(F.lit("reject-high").alias("action"), "id").union(curation.bulk_candidates(r, "keep-clear").select(F.lit("keep-clear"), "id"))


@query(f"WITH {_Q} SELECT count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'reject') AS rejected, count(decision) AS reviewed, greatest(0, count(*) - count(decision)) AS remaining, count(*) FILTER (screened AND (hi OR mid)) AS flagged FROM docq")
def q_curator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17."""
    r = _queue(spark, sf_dir)
    return curation.statistics(r, r.filter("decision is not null").select("id", "decision"))


@query(f"WITH {_Q} SELECT 'signal' AS kind, name FROM (SELECT DISTINCT 'contact_email' AS name FROM docq WHERE screened AND hi UNION SELECT DISTINCT 'possible_face' FROM docq WHERE screened AND mid) UNION ALL SELECT DISTINCT 'tag', 'Tag' || (pos % 5)::VARCHAR FROM docq UNION ALL SELECT DISTINCT 'category', category FROM docq")
def q_signal_tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16."""
    r = _queue(spark, sf_dir)
    signals = curation.signal_names(r).select(F.lit("signal").alias("kind"), F.col("signal").alias("name"))
    tags = curation.tag_names(r.select("pos", "tags")).select(F.lit("tag"), "label")
    return signals.union(tags).union(r.select(F.lit("category"), "category").distinct())


@query(f"WITH {_Q} SELECT id, CASE WHEN NOT screened THEN 'Not screened' WHEN hi THEN 'High risk' WHEN mid THEN 'Review suggested' ELSE 'Clear' END AS label, CASE WHEN NOT screened THEN '' ELSE concat_ws(',', CASE WHEN hi THEN 'contact_email' END, CASE WHEN mid THEN 'possible_face' END) END AS flags FROM docq")
def q_status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-20, SRT-04."""
    names = F.transform(screening.sorted_flags(F.col("screening.flags")), lambda f: f["name"])
    return _queue(spark, sf_dir).select("id", screening.status_label(F.col("screening")).alias("label"), F.coalesce(F.array_join(names, ","), F.lit("")).alias("flags"))


@query(with_views("decisions", "SELECT id, title FROM decided WHERE decision IS NULL OR decision = 'keep'"))
def q_apply_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06, JN-07."""
    return curation.apply(views.rounds(spark, sf_dir), views.decisions(spark, sf_dir)).select("id", "title")


@query(with_views("decisions", "SELECT id, title FROM decided WHERE decision = 'keep'"))
def q_apply_curation_only_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06."""
    return curation.apply(views.rounds(spark, sf_dir), views.decisions(spark, sf_dir), only_kept=True).select("id", "title")


@query(with_views("decisions", "SELECT count(*) AS rounds_before, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision IS NULL) AS unreviewed, count(*) FILTER (decision IS NULL OR decision = 'keep') AS rounds_after, (SELECT count(*) FROM decisions WHERE id LIKE 'x%' AND decision = 'keep') AS unknown_kept, (SELECT count(*) FROM decisions WHERE id LIKE 'x%' AND decision = 'reject') AS unknown_rejected FROM decided"))
def q_curation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, JN-08."""
    return curation.summary(views.rounds(spark, sf_dir), views.decisions(spark, sf_dir))


@query(with_views("decisions", "SELECT id, decision FROM decisions WHERE id NOT IN (SELECT id FROM rounds)"))
def q_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08."""
    return curation.unknown(views.decisions(spark, sf_dir), views.rounds(spark, sf_dir)).select("id", "decision")


@query(with_views("decisions", "SELECT id FROM decisions WHERE decision = 'keep' INTERSECT SELECT id FROM decisions WHERE decision = 'reject'"))
def q_decision_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-04, SET-03."""
    return curation.check_decisions(views.decisions(spark, sf_dir))


@query(f"WITH {_Q} SELECT id, CASE WHEN decision IS NULL AND screened AND hi THEN 'reject' ELSE decision END AS after_bulk, decision AS after_undo FROM docq WHERE decision IS NOT NULL OR (screened AND hi)")
def q_bulk_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-03: decisions after a bulk rejection and after its undo."""
    r = _queue(spark, sf_dir)
    now = r.filter("decision is not null").select("id", "decision")
    after, undo = curation.apply_bulk(now, curation.bulk_candidates(r, "reject-high"), "reject")
    back = curation.undo_bulk(after, undo).withColumnRenamed("decision", "after_undo")
    return after.withColumnRenamed("decision", "after_bulk").join(back, "id", "left")


@query(f"WITH {_Q} SELECT id, CASE WHEN pos % 6 = 0 THEN 'reject' WHEN pos % 4 = 0 THEN 'keep' ELSE decision END AS decision FROM docq WHERE decision IS NOT NULL OR pos % 6 = 0 OR pos % 4 = 0")
def q_import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-04, STA-08: an import overwrites; its rejections win over its keeps; unknown ids and values are left out."""
    r = _queue(spark, sf_dir)
    own = r.filter("decision is not null").select("id", "decision")
    keep, reject = (r.filter(f"pos % {n} = 0").select("id", F.lit(d).alias("decision")) for n, d in ((4, "keep"), (6, "reject")))
    junk = r.filter("pos % 9 = 0").select(F.concat(F.lit("?"), "id").alias("id"), F.lit("keep").alias("decision")).union(r.filter("pos % 9 = 1").select("id", F.lit("maybe")))
    return curation.import_merge(own, keep.union(reject).union(junk), r)


# --- workspaces --------------------------------------------------------------------------------

_SIDES = """base AS (SELECT event_id AS key, event_type AS value FROM events WHERE event_id % 2 = 0), loc AS (SELECT event_id AS key, CASE WHEN event_id % 6 = 0 THEN 'L' ELSE event_type END AS value FROM events WHERE event_id % 2 = 0 AND event_id % 10 <> 0 OR event_id % 7 = 0),
rem AS (SELECT event_id AS key, CASE WHEN event_id % 9 = 0 THEN 'R' ELSE event_type END AS value FROM events WHERE event_id % 2 = 0 AND event_id % 14 <> 0 OR event_id % 11 = 0),
j AS (SELECT key, b.key IS NOT NULL AS bp, b.value AS bv, l.key IS NOT NULL AS lp, l.value AS lv, r.key IS NOT NULL AS rp, r.value AS rv FROM (SELECT key FROM base UNION SELECT key FROM loc UNION SELECT key FROM rem) k LEFT JOIN base b USING (key) LEFT JOIN loc l USING (key) LEFT JOIN rem r USING (key)),
m AS (SELECT *, (lp = bp AND lv IS NOT DISTINCT FROM bv) AS l_same, (rp = bp AND rv IS NOT DISTINCT FROM bv) AS r_same, (lp = rp AND lv IS NOT DISTINCT FROM rv) AS lr_same FROM j)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    side = lambda wanted, n, mark: e.filter(wanted).select(k.alias("key"), F.when(k % n == 0, mark).otherwise(F.col("event_type")).alias("value"))
    base = e.filter("event_id % 2 = 0").select(k.alias("key"), F.col("event_type").alias("value"))
    return base, side("event_id % 2 = 0 and event_id % 10 <> 0 or event_id % 7 = 0", 6, "L"), side("event_id % 2 = 0 and event_id % 14 <> 0 or event_id % 11 = 0", 9, "R")


for _strategy in workspace.STRATEGIES:

    def _merge(strategy: str) -> None:
        def f(spark: SparkSession, sf_dir: str) -> DataFrame:
            """JN-12, STA-01, SET-04."""
            return workspace.merge3(*_sides(spark, sf_dir), strategy).select("key", "value", "present", "conflict")

        f.__name__ = f"q_three_way_merge_{strategy}"
        other = "l" if strategy == "prefer_local" else "r"
        pick = lambda c: f"CASE WHEN l_same THEN r{c} WHEN r_same OR lr_same THEN l{c} ELSE {other}{c} END"
        query(f"WITH {_SIDES} SELECT key, {pick('v')} AS value, {pick('p')} AS present, NOT l_same AND NOT r_same AND NOT lr_same AS conflict FROM m")(f)

    _merge(_strategy)


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").cast("string").alias("dataset_signature"), n.cast("long").alias("revision"), "props", F.col("event_type").alias("actor"))


_REV = "revs AS (SELECT user_id::VARCHAR AS dataset_signature, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, props, event_type AS actor FROM events)"


@query(f"WITH {_REV} SELECT dataset_signature, max(revision) AS revision, arg_max(actor, revision) AS actor FROM revs GROUP BY 1")
def q_revision_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15."""
    return workspace.head(_revisions(spark, sf_dir)).select("dataset_signature", "revision", "actor")


@query(f"WITH {_REV} SELECT revision, actor FROM revs WHERE dataset_signature = (SELECT min(dataset_signature) FROM revs) ORDER BY revision DESC LIMIT 20")
def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15, SRT-08: the last revisions, a top-k."""
    r = _revisions(spark, sf_dir)
    return workspace.history(r, r.agg(F.min("dataset_signature")).first()[0]).select("revision", "actor")


# --- caches ------------------------------------------------------------------------------------

_CACHE = """refs AS (SELECT DISTINCT review_image AS path FROM rounds WHERE review_image LIKE 'assets/reviews/%'), files AS (SELECT 'assets/reviews/' || pos::VARCHAR || '.jpg' AS path, pos * 10 AS length FROM rounds WHERE pos % 8 <> 0 AND pos % 2 = 0),
rec AS (SELECT coalesce(r.path, f.path) AS path, CASE WHEN r.path IS NULL THEN 'orphaned' WHEN f.path IS NULL THEN 'missing' ELSE 'existing' END AS state, length FROM refs r FULL JOIN files f ON r.path = f.path)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.rounds(spark, sf_dir)
    files = r.filter("pos % 8 <> 0 and pos % 2 = 0").select(F.concat(F.lit("assets/reviews/"), F.col("pos").cast("string"), F.lit(".jpg")).alias("path"), (F.col("pos") * 10).alias("length"))
    return assets.reconcile(assets.references(r, r.filter("pos % 4 = 0")), files)


@query(with_views("rounds", "SELECT path, state, length FROM rec", _CACHE))
def q_cache_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09, SET-02, SET-03, FLT-16, FLT-18."""
    return _reconciled(spark, sf_dir)


@query(with_views("rounds", "SELECT state, count(*) AS files, coalesce(sum(length), 0)::BIGINT AS bytes FROM rec GROUP BY state", _CACHE))
def q_cache_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12."""
    return assets.totals(_reconciled(spark, sf_dir))


@query(with_views("rounds", "SELECT id, CASE WHEN review_image LIKE 'assets/reviews/%' THEN 'https://cdn.example.com/x/' || substr(review_image, 16) ELSE review_image END AS image FROM rounds"))
def q_asset_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-18."""
    return views.rounds(spark, sf_dir).select("id", assets.deliver(F.col("review_image"), "assets/reviews", "https://cdn.example.com/x").alias("image"))


_BITS = "h AS (SELECT vec_id AS id, list_reduce(list_concat([0::HUGEINT], list_transform(generate_series(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END)), lambda a, b: a + b) AS h FROM embeddings)"


def _dhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    # bits are disjoint, so adding with the sign bit last can't overflow
    value = F.aggregate(F.transform("embedding", bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), value.alias("dhash"))


@query(f"WITH {_BITS} SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 16")
def q_hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14, SCL-21, SCL-22."""
    return assets.hamming_pairs(_dhashes(spark, sf_dir), 16)


@query(f"WITH {_BITS} SELECT id, part, ((h >> (CASE WHEN part < 13 THEN part * 4 ELSE 52 + (part - 13) * 3 END)::INT) & (CASE WHEN part < 13 THEN 15 ELSE 7 END))::BIGINT AS value FROM h, (SELECT unnest(generate_series(0, 16))::INT AS part)")
def q_pigeonhole_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-22: 17 segments of each hash."""
    return _dhashes(spark, sf_dir).select("id", F.explode(hashing.segments(F.col("dhash"), 16)).alias("s")).select("id", "s.part", "s.value")


@query(f"""WITH RECURSIVE {_BITS},
o AS (SELECT id, h, row_number() OVER (ORDER BY id) AS n FROM h),
g AS (SELECT 0::BIGINT AS n, []::HUGEINT[] AS kept, NULL::BIGINT AS id, NULL::HUGEINT AS h, false AS taken
 UNION ALL SELECT o.n, CASE WHEN len(list_filter(g.kept, lambda k: bit_count(xor(k, o.h)) <= 16)) = 0 THEN list_append(g.kept, o.h) ELSE g.kept END, o.id, o.h, len(list_filter(g.kept, lambda k: bit_count(xor(k, o.h)) <= 16)) = 0 FROM g JOIN o ON o.n = g.n + 1)
SELECT id, format('{{:016x}}', h::UBIGINT) AS dhash FROM g WHERE taken""")
def q_greedy_perceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: rows in order, without those near a kept one. Tested against a plain loop."""
    return assets.greedy_perceptual(_dhashes(spark, sf_dir), 16).select("id", hashing.dhash_hex(F.col("dhash")).alias("dhash"))


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY sha256(text)")
def q_exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return assets.exact_distinct(d, pos="doc_id").select("doc_id", "sha256")


# --- projections and rules ---------------------------------------------------------------------


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages")
def q_url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-13, FLT-14, SCL-33."""
    return table(spark, sf_dir, "pages").select("page_id", text.image_host(F.col("url")).alias("host"), text.valid_image(F.col("url")).alias("valid"))


@query(with_views("products", "SELECT parent_asin, replace(replace(replace(category, ' ', '_and_'), '_and_', ' & '), '_', ' ') AS label, CASE WHEN length(leaf_category) >= 3 THEN substr(leaf_category, 1, 220) END AS title, round(price, 6) AS price FROM products"))
def q_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04, PRJ-05, PRJ-11, SCL-23: labels, titles with stray white space, prices written as text."""
    p = views.products(spark, sf_dir)
    messy = F.concat(F.lit("  "), F.replace("leaf_category", F.lit("#"), F.lit("#")), F.lit("\t "))
    return p.select("parent_asin", text.humanize(F.replace("category", F.lit(" "), F.lit("_and_"))).alias("label"), text.normalize_title(messy).alias("title"), r6(text.parse_price(F.concat(F.lit(" $"), F.col("price").cast("string")))).alias("price"))


@query(with_views("products", "SELECT parent_asin, category || '|' || leaf_category AS path FROM products"))
def q_category_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06."""
    raw = F.array(F.col("category"), F.lit("  "), F.upper("category"), F.concat("leaf_category", F.lit("  ")), F.lit(None))
    return views.products(spark, sf_dir).select("parent_asin", F.array_join(text.normalize_categories(raw), "|").alias("path"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_id % 3 = 0 AS valid FROM events")
def q_date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-28, FLT-15: a third of the keys name a day."""
    key = F.when(F.col("event_id") % 3 == 0, text.date_key(F.col("ts"))).when(F.col("event_id") % 3 == 1, "2026-02-30").otherwise("26-2-3")
    return table(spark, sf_dir, "events").select("event_id", text.date_key(F.col("ts")).alias("day"), text.valid_date_key(key).alias("valid"))


@query(with_views("rounds", """SELECT error, pos FROM (SELECT pos, unnest(list_filter([CASE WHEN pos % 60 = 0 THEN 'id is empty' END, CASE WHEN pos % 61 = 0 AND pos % 60 <> 0 AND pos > 61 THEN 'id is repeated' END,
 CASE WHEN review_image IS NULL OR review_image = 'odd' THEN 'image is no address or asset path' END, CASE WHEN pos % 62 = 0 THEN 'product is no object' END, CASE WHEN pos % 62 <> 0 AND len(choices) <> 4 THEN 'choices are not four' END,
 CASE WHEN pos % 62 <> 0 AND len(choices) = 4 AND len(list_distinct(list_transform(choices, lambda c: lower(c)))) <> 4 THEN 'choices repeat' END,
 CASE WHEN pos % 62 <> 0 AND rating IS NOT NULL AND pos % 17 = 0 THEN 'rating is not from 1 to 5' END], lambda x: x IS NOT NULL)) AS error FROM rounds)"""))
def q_validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-01, FLT-14: rounds with planted faults."""
    pos = F.col("pos")
    r = views.rounds(spark, sf_dir)
    r = r.withColumn("id", F.when(pos % 60 == 0, "").when(pos % 61 == 0, "same").otherwise(F.col("id"))).withColumn("rating", F.when(F.col("rating").isNotNull() & (pos % 17 == 0), 6.0).otherwise(F.col("rating")))
    r = r.withColumn("product", F.when(pos % 62 != 0, F.struct("title", "parent_asin")))
    return validate.pack_errors(r)


@query(with_views("decisions", "SELECT 1 AS version, 'sig' AS dataset_signature, (SELECT string_agg(id, ',' ORDER BY id) FROM decisions WHERE decision = 'keep') AS kept, (SELECT string_agg(id, ',' ORDER BY id) FROM decisions WHERE decision = 'reject') AS rejected"))
def q_export_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10."""
    e = curation.export_actions(views.decisions(spark, sf_dir), "sig")
    return e.select("version", "dataset_signature", F.array_join("kept_ids", ",").alias("kept"), F.array_join("rejected_ids", ",").alias("rejected"))


# --- more projections, caches and state --------------------------------------------------------


@query(with_views("rounds", "SELECT id, repeat('★', coalesce(rating, 0)::INT) || repeat('☆', 5 - coalesce(rating, 0)::INT) AS stars, category || ' · ' || leaf_category AS line FROM rounds"))
def q_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-20: stars and meta lines."""
    return views.rounds(spark, sf_dir).select("id", text.star_string(F.col("rating")).alias("stars"), text.meta_line(F.col("category"), F.lit(" "), F.col("leaf_category")).alias("line"))


@query("""SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 2 = 0 THEN replace(p_type, ' ', ' & ') ELSE replace(p_name, ' ', '_') END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'meta_' || replace(p_type, ' ', '_and_') || '.jsonl.gz' ELSE replace(p_name, ' ', '_') || '.jsonl' END AS item FROM part""")
def q_source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10, PRJ-11: a source for each part, named after its type or its name."""
    even = F.col("p_partkey") % 2 == 0
    path = F.when(even, F.concat(F.lit("https://x.example.com/raw/meta_"), F.replace("p_type", F.lit(" "), F.lit("_and_")), F.lit(".jsonl.gz/"))).otherwise(F.concat(F.lit("raw/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jsonl")))
    label = text.source_label(F.col("path"))
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), path.alias("path"))
    return raw.select("id", F.when(label.contains("_and_"), text.humanize(label)).otherwise(label).alias("label"), F.regexp_extract(F.regexp_replace("path", "/+$", ""), "([^/]*)$", 1).alias("item"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '.jpg' WHEN event_id % 4 = 1 THEN '.png' WHEN event_id % 4 = 2 THEN '.gif' ELSE '.img' END AS extension, CASE WHEN event_id % 4 = 0 THEN 'image/jpeg' WHEN event_id % 4 = 1 THEN 'image/png' WHEN event_id % 4 = 2 THEN 'image/gif' ELSE 'application/octet-stream' END AS content_type FROM events")
def q_asset_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14, PRJ-19: by first bytes, by type, by suffix, or unknown."""
    k = F.col("event_id") % 4
    content = F.when(k == 0, F.unhex(F.lit("FFD8FFE000"))).otherwise(F.lit("text").cast("binary"))
    kind, url = F.when(k == 1, "image/PNG; charset=x").otherwise(""), F.when(k == 2, "https://x/a.GIF?y=1").otherwise("https://x/a")
    e = assets.extension(content, kind, url)
    return table(spark, sf_dir, "events").select("event_id", e.alias("extension"), assets.content_type(F.concat(F.lit("f"), e)).alias("content_type"))


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.rounds(spark, sf_dir).filter("review_image is not null and pos % 6 <> 0")
    sha = F.sha2(F.col("title").cast("binary"), 256)
    return r.select(F.col("review_image").alias("url"), F.concat(F.lit("assets/reviews/"), F.substring(sha, 1, 24), F.lit(".jpg")).alias("path"), sha.alias("sha256"), F.col("pos").alias("dhash"))


@query(with_views("rounds", "SELECT id, 'assets/reviews/' || substr(f.sha, 1, 24) || '.jpg' AS review_image, review_image AS original, f.sha AS sha256, lpad(printf('%x', f.dhash), 16, '0') AS dhash FROM rounds JOIN (SELECT review_image AS url, min_by(sha256(title), pos) AS sha, min(pos) AS dhash FROM rounds WHERE review_image LIKE 'http%' AND pos % 6 <> 0 GROUP BY 1) f ON f.url = review_image"))
def q_attach_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06, PRJ-15, PRJ-16: rounds with their fetched images; those without one are dropped."""
    f = _fetched(spark, sf_dir).filter("url like 'http%'")
    return assets.attach_images(views.rounds(spark, sf_dir), f).select("id", "review_image", F.col("review_image_original").alias("original"), F.col("review_image_sha256").alias("sha256"), F.col("review_image_dhash").alias("dhash"))


@query("SELECT page_id, 'f' || page_id::VARCHAR || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.bin' END AS relative, 'cdn/x/f' || page_id::VARCHAR || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.bin' END AS object_key, length(html)::BIGINT AS size, CASE WHEN page_id % 2 = 0 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS content_type FROM pages")
def q_upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, SRT-07, PRJ-19: what would be published."""
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".jpg").otherwise(".bin"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("/srv/a/"), name).alias("path"), F.length("html").cast("long").alias("length"))
    plan = assets.upload_plan(files, "/srv/a", "/cdn/x/")
    return plan.select(F.regexp_extract("relative", "([0-9]+)", 1).cast("long").alias("page_id"), "relative", "object_key", "size", "content_type")


@query("SELECT doc_id, 'Tag ' || (doc_id % 3)::VARCHAR || '|other' AS tags, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'note ' || doc_id::VARCHAR END AS note, least(100, doc_id)::INT AS max_priority, CASE WHEN doc_id % 2 = 0 THEN 'all' ELSE lang END AS category FROM documents")
def q_annotations_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-25 to SCL-27: normalised tags, notes and presets."""
    k = F.col("doc_id")
    tags = F.array(F.concat(F.lit("Tag  "), (k % 3).cast("string")), F.lit(" "), F.concat(F.lit("tag "), (k % 3).cast("string")), F.lit("other"))
    note = text.normalize_annotation(F.concat(F.lit(" note "), k.cast("string"), F.lit("\n")), tags)
    preset = text.normalize_preset(F.lit("p"), {"category": F.when(k % 2 == 0, " ").otherwise(F.col("lang"))}, k.cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(note["tags"], "|").alias("tags"), F.when(k % 5 != 0, note["note"]).alias("note"), preset["max_priority"].alias("max_priority"), preset["category"].alias("category"))


@query(f"SELECT event_id, printf('%x', {q.fnv("'{' || chr(34) || 'a' || chr(34) || ':' || event_id::VARCHAR || ',' || chr(34) || 'b' || chr(34) || ':' || user_id::VARCHAR || '}'")}) AS fingerprint FROM events")
def q_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-30: the order of an object's keys doesn't matter."""
    e = table(spark, sf_dir, "events")
    pair = lambda n, c: F.concat(F.lit(f'"{n}": '), F.col(c).cast("string"))
    a, b = pair("a", "event_id"), pair("b", "user_id")
    doc = F.concat(F.lit("{"), F.when(F.col("event_id") % 2 == 0, F.concat(a, F.lit(", "), b)).otherwise(F.concat(b, F.lit(","), a)), F.lit("}"))
    return e.select("event_id", hashing.fingerprint(doc).alias("fingerprint"))


@query(f"WITH {_Q} SELECT id, CASE WHEN pos % 8 = 0 THEN 'keep' ELSE decision END AS decision FROM docq WHERE (decision IS NOT NULL OR pos % 8 = 0) AND pos % 8 <> 4")
def q_decision_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-06: the last change of a round holds; null clears it."""
    r = _queue(spark, sf_dir)
    now = r.filter("decision is not null").select("id", "decision")
    set_ = r.filter("pos % 8 = 0").select("id", F.lit("keep").alias("decision"), F.lit(2).alias("pos")).union(r.filter("pos % 8 = 0").select("id", F.lit("reject"), F.lit(1)))
    clear = r.filter("pos % 8 = 4").select("id", F.lit(None).cast("string").alias("decision"), F.lit(1).alias("pos"))
    return curation.upsert(now, set_.union(clear))


@query("WITH " + _Q + """, w AS (SELECT id, lead(id) OVER o AS l, lag(id) OVER o AS g, first_value(id) OVER o AS f, row_number() OVER o AS k, count(*) OVER () AS n FROM docq WINDOW o AS (ORDER BY priority DESC, pos))
 SELECT id, coalesce(l, (SELECT id FROM w WHERE k = 1)) AS next, coalesce(g, (SELECT id FROM w WHERE k = n)) AS previous FROM w""")
def q_queue_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: next and previous round of the whole queue, worst first, which wraps around."""
    return curation.cursor(_queue(spark, sf_dir), [F.col("analysis.curation_priority").desc(), F.col("pos").asc()])


@query(with_views("rounds", "SELECT id, source_category, title, 'https://www.amazon.com/dp/' || parent_asin AS source_url FROM (SELECT id, CASE WHEN source_category <> '' THEN source_category ELSE category END AS source_category, title, parent_asin FROM rounds WHERE review_image IS NOT NULL)"))
def q_round_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08, PRJ-09, FLT-01, FLT-02."""
    r = build.eligible_products(build.image_reviews(views.rounds(spark, sf_dir)))
    none = F.lit(None).cast("string")
    full = r.withColumns({"asin": F.col("parent_asin"), "product_image": none, "store": none, "timestamp": F.lit(0).cast("long")})
    return build.assemble(full).select("id", "source_category", "product.title", "product.source_url")


@query(with_views("rounds", "SELECT id, string_agg(c, '|' ORDER BY k, c) AS choices FROM (SELECT id, c, sha256('1337|' || id || '|' || c) AS k FROM (SELECT id, unnest(choices) AS c FROM rounds)) GROUP BY id"))
def q_shuffled_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-09."""
    return build.shuffled_choices(views.rounds(spark, sf_dir), SEED).select("id", F.array_join("choices", "|").alias("choices"))


@query(with_views("rounds", "SELECT count(*) FILTER (review_image IS NOT NULL) AS eligible_seen, count(*) FILTER (pos % 2 = 0) AS sampled, count(*) FILTER (pos % 4 = 0) AS matched, count(*) AS pool, count(*) FILTER (pos % 8 = 0) AS written FROM rounds"))
def q_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14."""
    r = views.rounds(spark, sf_dir)
    return build.build_stats(r, r.filter("pos % 2 = 0"), r.filter("pos % 4 = 0"), r, r.filter("pos % 8 = 0"))


# --- extensions --------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows."""
    return ev.tumbling(table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, n""")
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: session windows."""
    return ev.sessions(table(spark, sf_dir, "events"))


from roundforge.plans import files, more  # noqa: E402, F401  they add their queries to those above
