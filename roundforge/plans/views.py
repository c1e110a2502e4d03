"""Reviews, products, rounds and decisions derived from the test tables, as DataFrames and as SQL.

SQL views are common table expressions; ``with_views`` puts those a query needs in front of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundforge.functions import hashing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("pos"),
        F.concat(F.lit("P"), p.cast("string")).alias("parent_asin"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"),
        F.col("p_type").alias("category"),
        F.array("p_type", "p_brand").alias("category_path"),
        F.col("p_brand").alias("leaf_category"),
        F.col("p_retailprice").alias("price"),
    )


PRODUCTS = """products AS (SELECT p_partkey AS pos, 'P' || p_partkey::VARCHAR AS parent_asin, p_name || ' ' || p_type || ' ' || p_brand AS title,
 p_type AS category, [p_type, p_brand] AS category_path, p_brand AS leaf_category, p_retailprice AS price FROM part)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("parent_asin"),
        (1 + F.col("l_linenumber") % 5).cast("double").alias("rating"),
        F.col("l_quantity").cast("long").alias("helpful_vote"),
        (F.col("l_returnflag") == "N").alias("verified_purchase"),
        F.col("l_shipdate").alias("ts"),
        *["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


REVIEWS = """reviews AS (SELECT 'P' || l_partkey::VARCHAR AS parent_asin, (1 + l_linenumber % 5)::DOUBLE AS rating, l_quantity::BIGINT AS helpful_vote,
 l_returnflag = 'N' AS verified_purchase, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round for each product; a document with the product's number is its review; the choices are its own title and the next three of its category."""
    from pyspark.sql import Window

    p = products(spark, sf_dir)
    pos, name = F.col("pos"), F.col("pos").cast("string")
    image = F.when(pos % 9 == 0, F.lit(None)).when(pos % 10 == 1, "odd").when(pos % 4 == 0, F.concat(F.lit("assets/reviews/"), name, F.lit(".jpg"))).otherwise(F.concat(F.lit("https://Img"), (pos % 5).cast("string"), F.lit(".example.com:8080/r/"), name, F.lit(".jpg?x=1")))
    near = [F.lead("title", k).over(Window.partitionBy("category").orderBy("pos")) for k in (1, 2, 3)]
    out = p.withColumn("choices", F.array_compact(F.array(F.col("title"), *near))).withColumn("review_image", image)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("review_text"))
    return out.join(texts, "pos", "left").select(
        "pos",
        hashing.round_id(F.col("parent_asin"), F.coalesce("review_image", F.lit(""))).alias("id"),
        F.when(pos % 11 == 0, "").otherwise(F.col("category")).alias("source_category"),
        "category", "category_path", "leaf_category", "title", "price", "parent_asin", "choices", "review_image",
        F.concat(F.lit("Great "), F.substring_index("title", " ", 2)).alias("review_title"),
        "review_text",
        F.when(pos % 13 != 0, (1 + pos % 5).cast("double")).alias("rating"),
        (pos % 4).alias("helpful_vote"),
        (pos % 2 == 0).alias("verified_purchase"),
        F.when(pos % 3 != 0, F.concat(F.lit("https://shop.example.com/"), name)).alias("source_url"),
    )


ROUNDS = """rounds0 AS (SELECT *, CASE WHEN pos % 9 = 0 THEN NULL WHEN pos % 10 = 1 THEN 'odd' WHEN pos % 4 = 0 THEN 'assets/reviews/' || pos::VARCHAR || '.jpg'
 ELSE 'https://Img' || (pos % 5)::VARCHAR || '.example.com:8080/r/' || pos::VARCHAR || '.jpg?x=1' END AS review_image,
 lead(title, 1) OVER w AS n1, lead(title, 2) OVER w AS n2, lead(title, 3) OVER w AS n3 FROM products WINDOW w AS (PARTITION BY category ORDER BY pos)),
rounds AS (SELECT r.pos, substr(sha1(parent_asin || '|' || coalesce(review_image, '')), 1, 14) AS id, CASE WHEN r.pos % 11 = 0 THEN '' ELSE category END AS source_category,
 category, category_path, leaf_category, title, price, parent_asin, list_filter([title, n1, n2, n3], lambda x: x IS NOT NULL) AS choices, review_image,
 'Great ' || split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2) AS review_title, d.text AS review_text, CASE WHEN r.pos % 13 <> 0 THEN (1 + r.pos % 5)::DOUBLE END AS rating,
 r.pos % 4 AS helpful_vote, r.pos % 2 = 0 AS verified_purchase, CASE WHEN r.pos % 3 <> 0 THEN 'https://shop.example.com/' || r.pos::VARCHAR END AS source_url
 FROM rounds0 r LEFT JOIN documents d ON d.doc_id = r.pos)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps, rejections (some of the same ids), and ids that no round has."""
    r = rounds(spark, sf_dir).select("pos", "id")
    keep = r.filter("pos % 5 = 0").select("id", F.lit("keep").alias("decision"))
    reject = r.filter("pos % 7 = 0").select("id", F.lit("reject").alias("decision"))
    lost = r.filter("pos % 50 = 0").select(F.concat(F.lit("x"), "id").alias("id"), F.when(F.col("pos") % 100 == 0, "keep").otherwise("reject").alias("decision"))
    return keep.union(reject).union(lost)


DECISIONS = """decisions AS (SELECT id, 'keep' AS decision FROM rounds WHERE pos % 5 = 0 UNION ALL SELECT id, 'reject' FROM rounds WHERE pos % 7 = 0
 UNION ALL SELECT 'x' || id, CASE WHEN pos % 100 = 0 THEN 'keep' ELSE 'reject' END FROM rounds WHERE pos % 50 = 0),
decided AS (SELECT r.*, d.decision FROM rounds r LEFT JOIN (SELECT id, max(decision) AS decision FROM decisions GROUP BY id) d USING (id))"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and conversations as reviews to screen. A third of the documents get a handle, a place or a phone number."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    tail = F.when(k % 9 == 0, " by @some_one.x").when(k % 9 == 3, " at 48.8566, 2.3522 now").when(k % 9 == 6, " call 415-555-0132 or www.example.com/a").otherwise("")
    own = d.select(F.concat(F.lit("d"), k.cast("string")).alias("id"), F.lit("A title").alias("review_title"), F.concat("text", tail).alias("review_text"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("review_title"), F.col("html").alias("review_text"))
    talk = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit(None).cast("string").alias("review_title"), F.col("text").alias("review_text"))
    return own.union(pages).union(talk)


TEXTS = """texts AS (SELECT 'd' || doc_id::VARCHAR AS id, 'A title' AS review_title, text || CASE WHEN doc_id % 9 = 0 THEN ' by @some_one.x' WHEN doc_id % 9 = 3 THEN ' at 48.8566, 2.3522 now'
 WHEN doc_id % 9 = 6 THEN ' call 415-555-0132 or www.example.com/a' ELSE '' END AS review_text FROM documents
 UNION ALL SELECT 'p' || page_id::VARCHAR, url, html FROM pages UNION ALL SELECT 'c-' || conv_id::VARCHAR || '-' || turn::VARCHAR, NULL, text FROM conversations)"""

_NEEDS = {"products": PRODUCTS, "reviews": REVIEWS, "rounds": ROUNDS, "decisions": DECISIONS, "texts": TEXTS}
_AFTER = {"rounds": ["products"], "decisions": ["products", "rounds"]}


def with_views(names: str, sql: str, more: str = "") -> str:
    order = []
    for n in names.split():
        order += [x for x in [*_AFTER.get(n, []), n] if x not in order]
    parts = [_NEEDS[n] for n in order] + ([more] if more else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
