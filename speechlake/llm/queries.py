"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cws, fim, langid, lm, merkle, oracles, packing, pii, quality, sentencepieces, simhash, toxicity, urls
from .common import crc_mod, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.link_components(table(spark, sf_dir, "documents"), size=3, distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind < 4)

    def number(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    return docs.select("doc_id", *map(number, range(4)), F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


#: The listed entries that the contract names.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), listed)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score(docs, crc_mod(F.col("doc_id"), 7) != 2, tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    weights = toxicity.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, weights).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "sentence")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 0, merkle.lower_ascii)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"), salt="1:", share=90, spm=20)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    model = quality.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return quality.score(docs, model, limit=0.3).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLE_SQL = {
    "op5_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), ruled AS (
            SELECT *, CASE
                WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/'
            END AS rule
            FROM parts
        )
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op11_merkle_manifest": oracles.merkle(),
    "op12_fill_in_middle": oracles.FILL_IN_MIDDLE,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
