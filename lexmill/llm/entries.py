"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.chat_format import chat_format
from lexmill.llm.cotraining import classify
from lexmill.llm.decontaminate import contamination
from lexmill.llm.importance import importance_resample
from lexmill.llm.jaccard_join import jaccard_join
from lexmill.llm.language_id import identify
from lexmill.llm.language_model import language_model_scores
from lexmill.llm.oracles import OP11_SQL, OP12_SQL
from lexmill.llm.piece_codec import piece_digests
from lexmill.llm.quality_rules import quality_rules
from lexmill.llm.scratch import Scratch
from lexmill.llm.secret_scan import secret_scan
from lexmill.llm.sharding import shard
from lexmill.llm.spelling import spelling_variants
from lexmill.llm.token_orc import token_positions, write_token_orc


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("byte_bpe_50k.tiktoken"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("piece_bpe_32k.model"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-orc")
    write_token_orc(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("word_bpe_49k.json"), scratch.path("ids"))
    return token_positions(spark, scratch.path("ids"), scratch)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_format(spark, rows.unionByName(own), tokenizer("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: op1 by brute force: every pair of documents that share a shingle, links followed to their ends. The others but 11 and 12 run models,
#: tokenizers, laws of their own or patterns that DuckDB's regular expressions lack; their tests compare them with brute force.
OP1_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op11_importance_resampling": OP11_SQL, "op12_spelling_variants": OP12_SQL}
