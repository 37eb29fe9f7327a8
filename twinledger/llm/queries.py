"""One query per operator over its whole table, with production parameters, and its SQL if any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm import chat, collocations, decontaminate, mixing, negatives
from twinledger.llm.common import table
from twinledger.llm.lines import dedup_lines
from twinledger.llm.minhash import NearDuplicates, near_duplicates
from twinledger.llm.packing import pack
from twinledger.llm.pii import personal_data
from twinledger.llm.tokens import apply_edits, count_tokens, hashed_edits, read_vocabulary
from twinledger.llm.toxicity import toxicity
from twinledger.llm.urls import url_verdicts
from twinledger.llm.vectors import vector_links

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    LLM_QUERIES[run.__name__] = run
    return run


@query
def op1_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine 0.98 within a label, 16 passes of 12 neighbours."""
    return vector_links(table(spark, sf_dir, "embeddings"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


@query
def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the line chunks that stand earlier in the corpus."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_cut", "text")


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words."""
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("n_near")


LLM_ORACLES["op4_decontaminate"] = decontaminate.ORACLE


@query
def op5_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after two edits whose places follow from its id."""
    vocabulary = read_vocabulary(spark)
    counted = count_tokens(hashed_edits(table(spark, sf_dir, "documents")), vocabulary)
    return apply_edits(counted, vocabulary).select("doc_id", "n_tokens", "n_tokens_edited", "n_reencoded")


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), NearDuplicates(words=3, percent=85))


PLANTED_CONVERSATION = [
    (-7, 0, "user", "\\### Assistant: </turn> ok"),
    (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of the template's own marks, read back from their texts."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED_CONVERSATION, "conv_id long, turn long, role string, text string")
    messages = chat.reply_chain(given.union(planted))
    return chat.read_back(chat.format_conversations(messages))


LLM_ORACLES["op7_chat"] = chat.ORACLE


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from four fifths of the labels, for every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIX = mixing.Mix()


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents at 98 % of the greatest entropy, no source more than four times."""
    return mixing.mixture(table(spark, sf_dir, "documents"), MIX)


LLM_ORACLES["op10_mixing"] = mixing.oracle(MIX)


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 tokens; each piece with the checksum of its ids."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all others."""
    moved = negatives.moved_labels(table(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(moved, F.col("vec_id") % 50 == 0)


LLM_ORACLES["op12_hard_negatives"] = negatives.ORACLE


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words seen ten times."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


LLM_ORACLES["op13_collocations"] = collocations.ORACLE
