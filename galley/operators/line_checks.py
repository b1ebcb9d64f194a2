"""Checks that look at one line and its neighbours.

All of them are conditions over one pass of the lines: any selection of
checks is one scan, one projection and one explode, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import fixed_values as fx
from galley.functions.re2 import WHOLE, re2
from galley.functions.text import matches, trim_space
from galley.operators.derived import lines_in_place
from galley.operators.findings import finding


def _rules(check: str) -> list[tuple[str, Column]]:
    """[(rule, condition on the line)], in report order."""
    text, after, signs = F.col("text"), F.col("after"), F.col("signs")
    size = F.length(text)
    if check == "asterisks":
        return [(check, F.contains(text, F.lit("*")))]
    if check == "adjacent spaces":
        return [(check, F.contains(text, F.lit("  ")) & F.contains(trim_space(text), F.lit("  ")))]
    if check == "trailing spaces":
        return [(check, F.endswith(text, F.lit(" ")))]
    if check == "short lines":
        indented = F.startswith(text, F.lit(" "))
        followed = F.coalesce(after, F.lit("")) != ""
        return [(check, ~indented & size.between(1, fx.SHORT_LINE_MAX) & followed)]
    if check == "long lines":
        return [(check, size > fx.LONG_LINE_OVER)]
    if check == "ellipsis":
        # two full stops side by side, one that opens the line, or two with one space between
        likely = F.contains(signs, F.lit("..")) | F.startswith(text, F.lit(".")) | text.rlike(re2(r"\.\s\."))
        return [(check, likely & matches(text, *fx.ELLIPSIS))]
    if check == "curly quotes":
        return [
            ("floating quote", _holds(signs, "“”") & matches(text, *fx.FLOATING_QUOTE)),
            ("quote direction", _holds(signs, "‘“”") & text.rlike(_FROM_SIGN["quote direction"])),
        ]
    if check == "special situations":
        return special_line_rules()
    raise ValueError(f"unknown line check: {check}")


def signs_of(text: Column) -> Column:
    """The line with every run of ASCII letters and spaces as one space.

    A few characters that tell which rules a line can break at all: other
    characters side by side in the line are so here too.
    """
    return F.regexp_replace(text, "[a-zA-Z ]++", " ")


def _holds(signs: Column, *any_of: str) -> Column:
    """The line holds one of these strings, or one of these characters if given as one string."""
    found = F.lit(False)
    for part in any_of[0] if len(any_of) == 1 else any_of:
        found = found | F.contains(signs, F.lit(part))
    return found


def _likely() -> dict[str, Column]:
    """What a line must have to break a rule: cheap, and true for every line that does."""
    text, signs = F.col("text"), F.col("signs")
    return {
        "mixed letters and numbers in word": signs.rlike(r"\p{Nd}"),
        "opening square bracket followed by other than I, G, M, S or number": _holds(signs, "["),
        "punctuation error": _holds(signs, ",.", ".,", ",,", ".."),
        "single character line": F.octet_length(text) <= 4,
        "broken hyphenation": _holds(signs, "-"),
        "date format": F.contains(signs, F.lit(",1")),
        "I/! check": _holds(signs, "”"),
        "disjointed contraction": _holds(signs, "’"),
        "spaced punctuation": _holds(signs, "?!:;"),
        "abandoned HTML tag": _holds(signs, "<"),
        "quote error (context)": _holds(signs, "‘“”"),
        "standalone 0": _holds(signs, "0"),
        "standalone 1": _holds(signs, "1"),
        "abbreviation &c without period": _holds(signs, "&"),
        "line that starts with hyphen and then non-hyphen": F.startswith(text, F.lit("-")),
    }


# The same lines hit, found from the sign after the letters, as letters are many.
_FROM_SIGN = {
    "mixed letters and numbers in word": rf"\p{{Nd}}(?:(?=\p{{L}})|(?<={WHOLE}\p{{L}}\p{{Nd}}))",
    # no letter but t, h and e folds to one of them
    "punctuation after 'the'": r"""[.,?'";:!@#$^&()](?<=(?<![0-9A-Za-z_])[tT][hH][eE].)""",
    "broken hyphenation": rf"-(?:(?<={WHOLE}\p{{L}}-) \p{{L}}|(?<={WHOLE}\p{{L}} -)\p{{L}})",
    "comma spacing": r",(?:(?<=[a-zA-Z_],)[a-zA-Z_0-9]|(?<=[\t\n\f\r ],)|(?<=\A,))",
    "title abbreviation comma": r",(?<=Mr,|Mrs,|Dr,)",
    "quote error (context)": (
        r"[‘“”](?:(?<=[.,;!?’‘A-LN-Za-z]‘|[.,;!?’‘A-Za-z]“| ”)|(?<=“)(?= )|(?<=‘)(?=s[\t\n\f\r ]))"
    ),
    "quote direction": r"[‘“”](?:(?<=[.,;!?A-Za-z][‘“])|(?<=”)(?=[A-Za-z]))",
}


_DASH_NAMES = ["adjacent dashes", *[name for name, _ in fx.DASH_CLASSES], "unrecognized dash"]


def special_line_rules() -> list[tuple[str, Column]]:
    text, after, lower = F.col("text"), F.col("after"), F.col("lower_text")
    likely = _likely()
    rules = [("paragraph ends in comma", F.endswith(text, F.lit(",")) & (after == ""))]
    for name, hits, excuses in fx.SPECIAL_LINE_RULES:
        found = text.rlike(_FROM_SIGN[name]) if name in _FROM_SIGN else matches(text, *hits)
        if name in likely:
            found = likely[name] & found
        rules.append((name, found & ~matches(text, *excuses) if excuses else found))
    for name, parts in fx.SPECIAL_SUBSTRING_RULES:
        found = F.lit(False)
        for part in parts:
            lettered = any(c.isascii() and (c.isalpha() or c == " ") for c in part)
            found = found | F.contains(text if lettered else F.col("signs"), F.lit(part))
        rules.append((name, found))
    rules.append(("unexpected comma after word", lower.rlike(_after_word(",", fx.NO_COMMA_AFTER))))
    rules.append(("unexpected period after word", lower.rlike(_after_word(".", fx.NO_PERIOD_AFTER))))
    return rules


def no_comma_pattern() -> str:
    return r"\P{L}(" + "|".join(w + "," for w in fx.NO_COMMA_AFTER) + ")"


def no_period_pattern() -> str:
    return r"\P{L}(" + "|".join(w + r"\." for w in fx.NO_PERIOD_AFTER) + ")"


def _after_word(sign: str, words: list[str]) -> str:
    """``no_comma_pattern`` and ``no_period_pattern`` found from their sign."""
    return rf"[{sign}](?<={WHOLE}\P{{L}}(?:{'|'.join(words)})[{sign}])"


def without_legal_dashes(text: Column, opens: Column, keep_line_end: bool = False) -> Column:
    """The line with every legal use of a dash taken out."""
    opening = F.when(
        opens & F.contains(text, F.lit("—")),
        F.concat(
            F.substring_index(text, "—", 1),
            F.substr(text, F.length(F.substring_index(text, "—", 1)) + 2),
        ),
    ).otherwise(text)
    masked = opening
    for pattern, to in fx.DASH_LEGAL:
        if to == "—":
            to = "$1—$2"
        masked = F.regexp_replace(masked, re2(pattern), to)
    return masked if keep_line_end else F.regexp_replace(masked, re2(fx.DASH_LINE_END), "")


def dash_class() -> Column:
    """Class of the first dash fault left on a line, else NULL."""
    left = F.col("left_dashes")
    found = F.when(~left.rlike(fx.DASH_ANY), F.lit(None)).when(
        left.rlike(fx.DASH_ADJACENT), "adjacent dashes"
    )
    for name, dash in fx.DASH_CLASSES:
        found = found.when(F.contains(left, F.lit(dash)), name)
    return found.otherwise("unrecognized dash")


LINE_CHECKS = [
    "asterisks",
    "adjacent spaces",
    "trailing spaces",
    "short lines",
    "long lines",
    "ellipsis",
    "dash check",
    "curly quotes",
    "special situations",
]


def line_findings(
    books: DataFrame, checks: list[str] | None = None, rules: list[str] | None = None, verbose=False
) -> DataFrame:
    """Findings of the chosen checks (all by default) in one pass."""
    return line_findings_over(lines_in_place(books), checks, rules, verbose)


def line_findings_over(
    lined: DataFrame, checks: list[str] | None = None, rules: list[str] | None = None, verbose=False
) -> DataFrame:
    """The same over lines already cut (see ``lines_in_place``)."""
    lined = with_left_dashes(with_signs(lined), checks, verbose)
    return lined.select("doc_id", F.inline(line_hits(checks, rules)))


def with_signs(lined: DataFrame, where: Column | None = None) -> DataFrame:
    """Lines with what their rules ask first."""
    signs = signs_of(F.col("text"))
    signs = signs if where is None else F.when(where, signs)
    return lined.select("*", signs.alias("signs"), F.lower("text").alias("lower_text"))


def with_left_dashes(
    lined: DataFrame, checks: list[str] | None = None, verbose=False, where: Column | None = None
) -> DataFrame:
    """Lines ``with_signs`` and with what the legal dashes leave of them, where dashes are checked."""
    if checks is not None and "dash check" not in checks:
        return lined
    # the masking chain runs only on lines with a dash
    dashed = F.col("signs").rlike(fx.DASH_ANY)
    left = F.when(
        dashed if where is None else where & dashed,
        without_legal_dashes(F.col("text"), F.col("opens"), verbose),
    ).otherwise("")
    return lined.withColumn("left_dashes", left)


def line_hits(checks: list[str] | None = None, rules: list[str] | None = None) -> Column:
    """Findings of the line in ``line_no, text, after, opens, signs, lower_text, left_dashes``.

    Every condition yields the place of its rule in one list of names, so the
    finding is spelled out once for all of them.
    """
    names, hits = line_places(checks, rules)
    checks_of = F.array(*[F.lit(c) for c, _ in names])
    rules_of = F.array(*[F.lit(r) for _, r in names])

    def told(k: Column) -> Column:
        check = F.get(checks_of, k)
        n = F.when(check == "long lines", F.length("text")).otherwise(1)
        return finding(check, F.get(rules_of, k), line_no=F.col("line_no"), n=n, context=F.col("text"))

    return F.transform(F.array_compact(F.array(*hits)), told)


def line_places(
    checks: list[str] | None = None, rules: list[str] | None = None, at: int = 0
) -> tuple[list[tuple[str, str]], list[Column]]:
    """The ``(check, rule)`` of the chosen checks, and for each condition the place of
    its rule among them, counted from ``at``, NULL where the line in ``line_hits`` keeps it."""
    names: list[tuple[str, str]] = []
    hits = []
    for check in LINE_CHECKS if checks is None else checks:
        if check == "dash check":  # one class for a line at most
            among = F.array_position(F.array(*map(F.lit, _DASH_NAMES)), dash_class())
            wanted = [rules is None or name in rules for name in _DASH_NAMES]
            first = at + len(names)
            hits.append((among - 1 + first).cast("int") if all(wanted) else _only(among, wanted, first))
            names += [(check, name) for name in _DASH_NAMES]
            continue
        for rule, condition in _rules(check):
            if rules is None or rule in rules:
                hits.append(F.when(condition, F.lit(at + len(names))))
                names.append((check, rule))
    return names, hits


def _only(among: Column, wanted: list[bool], first: int) -> Column:
    chosen = [k + 1 for k, w in enumerate(wanted) if w]
    return F.when(among.isin(chosen), (among - 1 + first).cast("int"))
