"""The queries of the training-data operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, fill_middle, html_text, lexical_search, license_scan, line_dedup, mixture, neighbours, ngram_join, suffix_dedup, toxicity, url_filter, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of 5-word shingles and its component under Jaccard similarity of 0.75 or more."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    """The tokenizer of the queries: a file of public tokenizers, not of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, as it is or with other values in its slots."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later of repeated runs of lines of 50 words or more."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each vector whose id is divisible by 20."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum of ids, read back from shard files."""
    return wavelet.tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, base license phrases and labels, with those of the signature rules."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a factorization machine fitted on labelled rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and how many of them the mix takes."""
    return mixture.taken_words(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and put together around markers, and its text rebuilt from that."""
    return fill_middle.digests(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that an earlier one has."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_wavelet_tokens": op6_wavelet_tokens,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_mixture": op9_mixture,
    "op10_html_text": op10_html_text,
    "op11_fill_middle": op11_fill_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op3_url_filter": url_filter.ORACLE_SQL,
    "op4_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op9_mixture": mixture.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
    "op13_suffix_dedup": suffix_dedup.ORACLE_SQL,
}
