"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bin_completion, boosted_gam, bwt_dedup, context_tree, entropy_mix, host_consensus, permutation_index, quote_links, robust_outliers, simhash_ball
from .common import table


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.robust_outliers(table(spark, sf_dir, "documents"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op3_boosted_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents"))


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.conversations(table(spark, sf_dir, "conversations"))


def op6_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_documents(table(spark, sf_dir, "documents"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


def op8_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_consensus.extract(table(spark, sf_dir, "pages"))


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.simhash_groups(table(spark, sf_dir, "documents")).drop("row_key")


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: For pages of the test tables' one template, where the article element is what the hosts agree on.
PAGES_SQL = r"""with a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|<footer>|$)', 1) as body from pages),
 b as (select page_id, url, list_filter(list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') as blocks from a),
 c as (select page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') as text from b)
select page_id, url, text, length(text)::bigint as n_chars from c"""


def oracle_sql() -> dict[str, str]:
    return {"op8_host_consensus": PAGES_SQL}
