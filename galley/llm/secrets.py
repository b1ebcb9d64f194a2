"""Secret scan with multipart credential linking.

Strong findings stand alone: assigned secrets, access keys and long hex runs.
Weak candidates (an identifier, a key-like token, an endpoint) are reported
only if a complementary part lies within ``SCOPE`` characters of them: an
identifier or an endpoint needs a secret, a key-like token needs an identifier
or an endpoint.  The distance is the gap from the end of one part to the start of
the other, 0 if they overlap.  The link is an interval join: parts enter every bin
of ``SCOPE`` characters they cover and are folded to the first start and last end
per ``(document, bin, role)``, and each weak candidate meets its own bins and two
on either side.  So a candidate has at most three partners for each bin, however
many parts a document holds.

All of it is DataFrame work.  Offsets are code points, ends exclusive.  A null
text is empty.  Rows with equal ``doc_id`` and text get equal results, one for
each; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.arrays import let, running_sums
from galley.llm.common import text_or_empty

SCOPE = 200
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KEY_LIKE = r"[A-Za-z0-9+/_-]{32,}={0,2}"
LOGIN = r"""(?i)(?<![a-z0-9])(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"""(?i)[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}"""
KINDS = ["assign", "access", "hex", "key", "login", "endpoint"]
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "login": "id", "endpoint": "endpoint"}
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: str, good=None, group: int = 0) -> Column:
    """``(start, kind, end)`` of every match; ``good`` filters by the group's text."""
    none = F.array().cast(_SPAN)
    code = F.lit(KINDS.index(kind))

    def listed(m: Column, at: Column, wanted: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            fits = good(F.get(wanted, i)) if good else F.lit(True)
            start = F.get(at, i + 1) - F.length(x)
            return F.when(
                fits, F.struct(start.alias("start"), code.alias("kind"), F.get(at, i + 1).alias("end"))
            )

        return F.filter(F.transform(m, span), lambda x: x.isNotNull()).cast(_SPAN)

    def placed(m: Column) -> Column:
        # every array is bound once, so that no element computes it anew
        wanted = F.regexp_extract_all(text, F.lit(pattern), group) if group else m
        return let(
            F.split(text, pattern, -1),
            lambda gaps: let(
                F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i))),
                lambda steps: let(running_sums(steps), lambda at: let(wanted, lambda w: listed(m, at, w))),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def _mixed(token: Column) -> Column:
    """Key-like: digits, small letters and capitals in one token."""
    return token.rlike("[0-9]") & token.rlike("[a-z]") & token.rlike("[A-Z]")


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id, th, base, weak`` of every row: strong spans and weak candidates."""
    text = F.col("_t")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text_or_empty().alias("_t")
    )
    base = F.concat(
        _spans(text, ASSIGN, "assign", lambda g: F.length(g) >= 6, group=2),
        _spans(text, ACCESS, "access", lambda g: F.length(g) >= 20),
        _spans(text, HEX, "hex"),
    )
    weak = F.concat(
        _spans(text, KEY_LIKE, "key", _mixed),
        _spans(text, LOGIN, "login"),
        _spans(text, ENDPOINT, "endpoint"),
    )
    return rows.select("doc_id", "th", F.array_sort(base).alias("base"), F.array_sort(weak).alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, th, extra``: the weak candidates with a complementary part in reach."""
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("s.kind") + 1)
    key = ["doc_id", "th"]
    some = found.filter(F.size("weak") > 0).dropDuplicates(key)
    each = some.select(*key, F.explode(F.concat("base", "weak")).alias("s")).select(
        *key,
        "s",
        role.alias("role"),
        F.floor(F.col("s.start") / scope).alias("bin"),
        F.floor((F.col("s.end") - 1) / scope).alias("upto"),
    )
    covered = each.select(*key, "s", "role", F.explode(F.sequence("bin", "upto")).alias("bin"))
    folded = covered.groupBy(*key, "bin", "role").agg(
        F.min("s.start").alias("first"), F.max("s.end").alias("last")
    )
    folded = folded.select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("bin").alias("_bin"), F.col("role").alias("other"), "first", "last"
    )
    weak = each.filter(F.col("s.kind") >= 3)
    # a start SCOPE behind an exclusive end may be two bins from the last character
    reach = weak.select("*", F.explode(F.sequence(F.col("bin") - 2, F.col("upto") + 2)).alias("near"))
    fits = ((F.col("role") == "secret") & (F.col("other") != "secret")) | (
        (F.col("role") != "secret") & (F.col("other") == "secret")
    )
    # the first start of a later bin and the last end of an earlier one are the nearest
    close = (
        F.when(F.col("near") < F.col("bin"), F.col("s.start") - F.col("last") <= scope)
        .when(F.col("near") > F.col("upto"), F.col("first") - F.col("s.end") <= scope)
        .otherwise(True)
    )
    same = reach["doc_id"].eqNullSafe(folded["_id"]) & (reach["th"] == folded["_th"]) & (reach["near"] == folded["_bin"])
    met = reach.join(folded, same).filter(fits & close)
    return met.groupBy(*key).agg(F.collect_set("s").alias("extra"))


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    A weak candidate inside a strong finding is that finding and adds nothing.
    """
    found = parts(docs)
    inside = lambda w, b: (b["start"] <= w["start"]) & (w["end"] <= b["end"])
    extra = linked(found, scope).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "extra")
    both = found.join(extra, found["doc_id"].eqNullSafe(extra["_id"]) & (found["th"] == extra["_th"]), "left")
    more = F.filter(
        F.coalesce("extra", F.array().cast(_SPAN)), lambda w: ~F.exists("base", lambda b: inside(w, b))
    )
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return both.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", more))).alias("spans"),
    )
