"""The canonical reads relation, and reads made from the test tables.

sample, file_idx, ord (1-based among all records), ord_pf (among unfiltered ones), ord_q (among unfiltered ones with
qualities), id, sequence (upper case), quality (ASCII), is_filtered, colorspace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.letters import mapped
from .session import spread

SCHEMA = "sample string, file_idx int, ord long, ord_pf long, ord_q long, id string, sequence string, quality string, is_filtered boolean, colorspace string"

#: The same select for Spark (S = string, G = nothing) and DuckDB (S = varchar, G = ,'g').
SHORT = """select event_id+1 as ord,
  concat('@SIM:1:FC:1:',cast(1101+event_id%8 as {S}),':',cast(event_id as {S}),':1') as id,
  substr(translate(concat(md5(concat(event_type,cast(user_id%50 as {S}))),md5(concat(cast(user_id%50 as {S}),event_type))),
                   '0123456789abcdef','ACGTACGTACGTACGN'),1,cast(30+user_id%11 as int)) as sequence,
  substr(translate(concat(md5(cast(event_id as {S})),md5(cast(event_id+7 as {S}))),
                   '0123456789abcdef','IIIIHHGGFEDC@?:5'),1,cast(30+user_id%11 as int)) as quality,
  event_id%17=0 as is_filtered
from {events}"""
MID = """select event_id+1 as ord, concat('@MID:1:FC:1:1101:',cast(event_id as {S}),':1') as id,
  substr(case when event_id%10=3 then concat(substr(b,1,cast(user_id%60 as int)),'AGATCGGAAGAG',b) else b end,
         1,cast(100+user_id%21 as int)) as sequence,
  substr(translate(concat(md5(cast(event_id as {S})),md5(cast(event_id+1 as {S})),md5(cast(event_id+2 as {S})),md5(cast(event_id+3 as {S}))),
                   '0123456789abcdef','IIIIHHGGFEDC@?:5'),1,cast(100+user_id%21 as int)) as quality,
  false as is_filtered
from (select event_id,user_id,
        translate(concat(md5(concat('a',cast(event_id%700 as {S}))),md5(concat('b',cast(event_id%700 as {S}))),
                         md5(concat('c',cast(event_id as {S}))),md5(concat('d',cast(event_id as {S})))),
                  '0123456789abcdef','ACGTACGTACGTACGN') as b
      from {events}) t"""
LONG = """select doc_id+1 as ord, concat('@LONG:',cast(doc_id as {S})) as id,
  translate(regexp_replace(text,'[^A-Za-z]','N'{G}),
    'ABCDEFGHIJKLMOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
    'ACGTACGTACGTACGTACGTACGTAACGTACGTACGTACGTACGTACGTAC') as sequence,
  '' as quality, false as is_filtered
from {documents}"""
VIEWS = {"short": SHORT, "mid": MID, "long": LONG}


_HEX = lambda to: bytes(range(256)).translate(bytes.maketrans(b"0123456789abcdef", to))
_BASES, _QUALITIES = _HEX(b"ACGTACGTACGTACGN"), _HEX(b"IIIIHHGGFEDC@?:5")
_FROM, _TO = (bytes(range(65, 91)).replace(b"N", b"") + bytes(range(97, 123)), b"ACGTACGTACGTACGTACGTACGTAACGTACGTACGTACGTACGTACGTAC")
_PLAIN = bytes(_TO[_FROM.index(c)] if c in _FROM else ord("N") for c in range(256))
#: For each view: the table, its columns, the select in Spark up to the letters of sequence and quality (the same as above, cut before it is
#: translated), and the letters: what translate() looks up in a map a character is put by a table a batch.
SPARK = {
    "short": ("events", ("event_id", "user_id", "event_type"), (
        "event_id+1 as ord", "concat('@SIM:1:FC:1:',cast(1101+event_id%8 as string),':',cast(event_id as string),':1') as id",
        "substr(concat(md5(concat(event_type,cast(user_id%50 as string))),md5(concat(cast(user_id%50 as string),event_type))),1,cast(30+user_id%11 as int)) as sequence",
        "substr(concat(md5(cast(event_id as string)),md5(cast(event_id+7 as string))),1,cast(30+user_id%11 as int)) as quality", "event_id%17=0 as is_filtered",
    ), {"sequence": _BASES, "quality": _QUALITIES}),
    "mid": ("events", ("event_id", "user_id"), (
        "event_id+1 as ord", "concat('@MID:1:FC:1:1101:',cast(event_id as string),':1') as id",
        "substr(concat(case when event_id%10=3 then concat(substr({b},1,cast(user_id%60 as int)),'AGATCGGAAGAG') else '' end,{b}),1,cast(100+user_id%21 as int)) as sequence".format(
            b="concat(md5(concat('a',cast(event_id%700 as string))),md5(concat('b',cast(event_id%700 as string))),md5(concat('c',cast(event_id as string))),md5(concat('d',cast(event_id as string))))"),
        "substr(concat(md5(cast(event_id as string)),md5(cast(event_id+1 as string)),md5(cast(event_id+2 as string)),md5(cast(event_id+3 as string))),1,cast(100+user_id%21 as int)) as quality", "false as is_filtered",
    ), {"sequence": _BASES, "quality": _QUALITIES}),
    "long": ("documents", ("doc_id", "text"), ("doc_id+1 as ord", "concat('@LONG:',cast(doc_id as string)) as id", "text as sequence", "'' as quality", "false as is_filtered"),
             {"sequence": _PLAIN}),
}


def duckdb_reads(view: str) -> str:
    return VIEWS[view].format(S="varchar", G=",'g'", events="events", documents="documents")


def canonical(df: DataFrame, sample: str = "sample") -> DataFrame:
    """Reads from any frame of ord, id, sequence, quality, is_filtered, and ord_pf and ord_q if some records are counted out there (else they equal ord)."""
    place = lambda name: F.col(name if name in df.columns else "ord").cast("long").alias(name)
    return df.select(
        F.lit(sample).alias("sample"), F.lit(0).alias("file_idx"), place("ord"), place("ord_pf"), place("ord_q"),
        "id", F.upper("sequence").alias("sequence"), "quality", "is_filtered", F.lit(None).cast("string").alias("colorspace"),
    )


def fixture_reads(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The table's rows are dealt out as they are, before anything is made of them."""
    table, columns, made, letters = SPARK[view]
    made = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)).selectExpr(*made)
    made = made.withColumns({name: mapped(F.col(name), put) for name, put in letters.items()})
    if view == "short":  # every 17th event, from the first on, is filtered; all have qualities
        place = F.col("ord") - 1 - F.floor((F.col("ord") - 1) / 17)
        made = made.withColumns({name: F.when(~F.col("is_filtered"), place) for name in ("ord_pf", "ord_q")})
    return canonical(made, view)


def passed(reads: DataFrame) -> DataFrame:
    """What every module but the basic statistics sees."""
    return reads.where(~F.col("is_filtered"))
