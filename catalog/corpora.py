"""Corpora the queries run on: the given tables, and marked-up copies of them.

The generated documents hold no curly quotes, blank lines, footnotes and so
on.  A marked-up copy is the whole ``documents`` table with frequent words and
signs replaced by the features a check looks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.text import replace_all
from galley.sources.books import from_parquet

TYPESET = [
    ("\n", "\n\n"),
    (" an ", " tomorrow "),
    (" or ", " to-morrow, Dr. "),
    (" of ", " to-day "),
    (" and ", " today "),
    (" with ", " Mr. "),
    (" for ", " mr "),
    (" that ", " Mrs. "),
    (" by ", " mrs "),
    (" the ", " dr "),
    (" it ", " north-east "),
    (" is ", " Southwest "),
    (" on ", " 5 a.m. "),
    (" as ", " 6 a. m. "),
    (" at ", " 7 p.m. "),
    (" in ", " 8 p. m. "),
    (" to ", " to-night "),
    (" was ", " tonight "),
    (" der ", " motor-car "),
    (" und ", " motorcar "),
    (" die ", " a-b-c "),
    (" den ", " a b c "),
    (" que ", " M’Donald "),
    (" la ", " M‘Gregor "),
    (" de ", " don't ‘you’ "),
    (" et ", " \"or\" “so” "),
    (" | ", " — "),
    ("###", "[1] "),
    ("%%%", "..."),
    ("$$$", "’"),
    ("&&&", "” "),
    ("***", " “"),
    ("! ", "!  "),
    (", ", " ,"),
]
DASHES = [
    (" the ", " – "),
    (" of ", "—"),
    (" and ", "—— "),
    (" to ", " -- "),
    (" in ", " — "),
    (" is ", " 3–4 "),
    (" that ", " 3 – 4 "),
    (" for ", " 555‒1212 "),
    (" it ", " ---------- "),
    (" was ", "— What "),
    (" on ", " _if—” "),
    (" with ", "‐"),
    (" be ", " well‑ known "),
    (" as ", " half‑ "),
    (" by ", " Mr. —— had "),
    (" are ", " I—” "),
    (".\n", "\n\n—So "),
    (" der ", "— "),
    (" die ", "-"),
    (" de ", " ‒ "),
    (" la ", " ‐ "),
    (" le ", " ⸺ "),
    (" que ", "‑"),
]
SPACING = [
    ("e.\n", "e.\n\n\n\n\n"),
    ("n.\n", "n.\n\n\n"),
    ("t.\n", "t.\n\n\n\n"),
    ("s.\n", "s.\n\n"),
    ("d.\n", "d.\n\n\n\n\n\n"),
    ("h.\n", "h.\n \n\n \n\n\n"),
    ("r.\n", "r.\n\n  "),
]
NOTES = [
    ("e.\n", "e. [1] and [2] and [4]\n"),
    ("n.\n", "n.\n[1] "),
    ("t.\n", "t.\n[Footnote 2: "),
    ("s.\n", "s.\n  Footnote 3: "),
    ("d.\n", "d.\n[4] [5] [6] "),
    ("h.\n", "h. [0] [7] [8]\n"),
]
QUOTES = [
    (".\n", ".\n\n"),
    (" the ", " “the "),
    (" of ", " of” "),
    (" and ", " ‘and "),
    (" to ", " to’ "),
    (" in ", " ’tis "),
    (" is ", " don’t "),
    (" it ", " o’ "),
    (" de ", " “de "),
    (" la ", " la” "),
    (" le ", " ‘le "),
    (" et ", " et’ "),
    (" der ", " ‘der "),
    (" die ", " die’ "),
    (" und ", " “und "),
    (" in ", " in” "),
    (" un ", ".“un‘ "),
    (" los ", " so”los "),
    ("ing ", "in’ "),
    (" h", " ’"),
    ("es ", "es’ "),
    ("e. ", "e.’ "),
    ("n. ", "n.” "),
]
SITUATIONS = [
    ("e.\n", "e,\n"),
    (",\n", ",\n\n"),
    (" an ", " axcb axgb axpb axsb axtb axwh axfr axbr axqu axtw axgl axfl axsw axgr axsl axcl axiy "),
    (" or ", " hrax hlax cbax sbax tbax wbax tlax tnax rnax ltax tjax "),
    (" to ", " [x "),
    (" in ", " well- known "),
    (" is ", " 8,1948 "),
    (" it ", " runI” "),
    (" by ", " I ’ve "),
    (" that ", " Mr, "),
    (" was ", " what ? "),
    (" are ", " <i>so</i> "),
    (" for ", " 1st and 3d or 4x "),
    (" with ", " &c "),
    (" as ", " ,, "),
    (" on ", " the, "),
    (" at ", " 0 or 1 "),
    (" this ", " Blank Page "),
    (" from ", "—-"),
    (" be ", "\u00a0"),
    (" he ", "\u00ad"),
    (" of the ", "\t"),
    (" a ", " “ "),
    (" der ", " tlinks sheiy "),
    (" die ", " hrubb "),
    (" und ", "\nx\n"),
    (" de ", "\n!so "),
    (" la ", "\n-so "),
    (" le ", " it's. "),
    (" les ", " \n"),
    (" et ", " the:"),
    (" que ", " an, in the. "),
    (" el ", "e..a"),
    (" en ", " cost $1 "),
    (" y ", " McKay ’tIs "),
]
PARAGRAPHS = [
    (".\n", ".\n\n"),
    (" the ", ".and "),
    (" of ", ".” and "),
    (" to ", " he bad "),
    (" and ", ". and "),
    (" in ", ", hut "),
    (" is ", ".” “So "),
    (" that ", " M.S.D. "),
    (" for ", " 5s. 6d. p. m. "),
    (" it ", " e. g. i. e. "),
    (" was ", " the had "),
    (" with ", " Mr. x. viii "),
    (" by ", " i.e. per cent. of "),
    ("e\n", "e_\n\nAN end"),
    (" la ", "\n\n  so "),
    (" le ", ".’"),
]
HYPHENS = [
    (" of ", " to-day "),
    (" and ", " to day "),
    (" to ", " To-Day "),
    (" the ", " today "),
    (" in ", " well-known- "),
    (" is ", " well known "),
    (" der ", " sésame-ouvre-toi "),
    (" die ", " sésame ouvre toi "),
    (" de ", " 4-5 "),
    (" la ", " 45 "),
]
LIST_FILES = [
    ("\n", " "),
    (" ", "|"),
    ("|the|", "\n*** BEGIN HE ***\n"),
    ("|and|", "\n*** END HE ***\n"),
    ("|of|", "\n*** BEGIN BE ***\n"),
    ("|to|", "\n*** END BE ***\n"),
    ("|in|", ":12\n"),
    ("|is|", ":x\n"),
    ("|de|", "\n*** BEGIN HE ***\n"),
    ("|la|", ":3\n"),
    (".|", ":7\n"),
]


# What a user declares right although the checks would report it: scannos that
# are words of these languages, a prefix, spellings with a space, a sign, a capital.
GOOD_WORDS = ["die", "bo", "tier", "attion", "ered", "thble", "it on", "of the", "'tis", "runI", "SSbe"]


def tasks(spark: SparkSession) -> int | None:
    """``galley.tasks`` of the session: deal these one-file tables to so many tasks."""
    asked = spark.conf.get("spark.galley.tasks", None)
    return int(asked) if asked else None


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return from_parquet(spark, f"{sf}/documents.parquet", tasks=tasks(spark))


def marked(spark: SparkSession, sf: str, seeds: list[tuple[str, str]]) -> DataFrame:
    books = documents(spark, sf)
    return books.select("doc_id", replace_all(F.col("text"), seeds).alias("text"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return from_parquet(spark, f"{sf}/pages.parquet", "page_id", "html", tasks(spark))


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return from_parquet(spark, f"{sf}/benchmark.parquet", "item_id")
