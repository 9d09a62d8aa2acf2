"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strail.llm import bpe, chat, decontam, embed_dedup, langid, quality, simhash, suffix_dedup, tokenbin, toxicity
from strail.llm.common import fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(mod: int, rest: int):
    return F.coalesce(fold("doc_id", mod) == rest, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(extra)), in_order=True)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, edits): each benchmark item that a document holds."""
    return decontam.contaminated(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenbin.token_records(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_chat_format, op3_embedding_dedup, op4_byte_bpe, op5_suffix_dedup, op6_simhash_dedup, op7_language_id, op8_decontaminate, op9_token_records, op10_quality)
}

_TEMPLATE = chat.Template()


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, {_quoted(_TEMPLATE.escape)}, {_quoted(_TEMPLATE.escape * 2)})"
    for c in _TEMPLATE.controls:
        out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + _TEMPLATE.escape + c[1:])})"
    return out


def _marks_sql() -> str:
    known = " ".join(f"WHEN role = {_quoted(r)} THEN {len(_TEMPLATE.open[r]) + len(_TEMPLATE.close[r])}" for r in _TEMPLATE.open)
    name = "role"
    for c in _TEMPLATE.coded:
        name = f"replace({name}, {_quoted(c)}, '%{ord(c):02X}')"
    return f"CASE {known} ELSE {len(_TEMPLATE.other[0]) - len('{role}') + len(_TEMPLATE.other[1])} + length({name}) END"


def _moves_sql(state: str, role: str) -> str:
    """Whether the move from a state to a role is allowed; the state before the first turn and the role after the last are null."""
    start = lambda k: f"{state} IS NULL" if k is chat.START else f"{state} = {_quoted(k)}"
    stop = lambda v: " OR ".join(f"{role} IS NULL" if x is chat.END else f"{role} = {_quoted(x)}" for x in v)
    return " OR ".join(f"({start(k)} AND ({stop(v)}))" for k, v in _TEMPLATE.moves.items())


#: The rest need a hash function, a tokenizer, a trained model or an edit distance that SQL lacks.
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": f"""WITH rows_ AS (SELECT conv_id, turn, coalesce(role, 'null') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, {_escaped_sql("text")} AS escaped FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + {_marks_sql()}) AS BIGINT) AS formatted_chars,
  bool_and(coalesce({_moves_sql("before", "role")}, false) AND (after IS NOT NULL OR coalesce({_moves_sql("role", "after")}, false))) AS valid FROM t GROUP BY conv_id""",
    "op3_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a), m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id""",
}
