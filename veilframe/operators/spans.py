"""Spans of rules, overlap resolution, tokens and rewriting, as Catalyst expressions over one row.

A span is a struct (s, e, rule, prio, category); offsets are code points, e is exclusive.  Text is made visible (control
and zero-width characters dropped) before rules look at it, and offsets are those of the visible text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import PRIORITY, action_of, placeholder, visible
from veilframe.sources.rules import Rule, RuleSet

SPAN = "array<struct<s:int,e:int,rule:string,prio:int,category:string>>"
MARK = "\u0001"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def java_pattern(pattern: str) -> str:
    """Rules are Unicode-aware: so are Java's classes and boundaries with this flag."""
    return f"(?U){pattern}"


#: Matches that are placed together; a list that grows by one each time is copied each time.
RUN = 64


def placed(pairs: Column, skip: bool) -> Column:
    """(gap, len) of each match, the gap counted from the end of the match before (or with skip=False from its start), to
    (s, e).  Runs of matches are placed from zero, then runs are moved to where they belong."""
    spot = "array<struct<s:int,e:int>>"

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + x["len"]
        return F.struct((e if skip else s).alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"))).alias("out"))

    def of(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(spot).alias("out"))
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(p, k * RUN + 1, F.lit(RUN)), zero, step))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:{spot}>>").alias("out"))
        moved = F.aggregate(runs, start, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("at"), r["out"].alias("out"))).alias("out")))
        whole = F.flatten(F.transform(moved["out"], lambda r: F.transform(r["out"], lambda x: F.struct((x["s"] + r["at"]).alias("s"), (x["e"] + r["at"]).alias("e")))))
        return F.when(F.size(p) > 0, whole).otherwise(F.array().cast(spot))

    return let(pairs, of)


def _pairs(gaps: Column, lens: Column) -> Column:
    return F.filter(F.arrays_zip(gaps.alias("gap"), lens.alias("len")), lambda x: x["len"].isNotNull())


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: an array of (s, e)."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    return placed(_pairs(gaps, F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda g: F.length(g))), skip=True)


def feasible(text: Column, pattern: str) -> Column:
    """One match for every start at which the pattern matches: an array of (s, e)."""
    look = f"(?=({pattern}))"
    lens = F.transform(F.regexp_extract_all(text, F.lit(look), 1), lambda m: F.length(m))
    gaps = F.transform(F.split(F.regexp_replace(text, look, MARK), MARK, -1), lambda g: F.length(g))
    return placed(_pairs(gaps, lens), skip=False)


def dictionary_pattern(term: str) -> str:
    """A term with no letter or digit beside it, ASCII case ignored."""
    quoted = "".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in term)
    return rf"(?i)(?<![\p{{IsAlphabetic}}\p{{N}}]){quoted}(?![\p{{IsAlphabetic}}\p{{N}}])"


def spans_of(text: Column, rule: Rule) -> Column:
    pattern = dictionary_pattern(rule.pattern) if rule.kind == "D" else java_pattern(rule.pattern)
    found = F.transform(
        feasible(text, pattern),
        lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(rule.id).alias("rule"), F.lit(PRIORITY[rule.action]).alias("prio"), F.lit(rule.category).alias("category")),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, rules: RuleSet) -> Column:
    """Spans of all dictionary and regular-expression rules by start, the longer first, then in rule order."""

    def keyed(order: int):
        return lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), F.lit(order).alias("k"), x.alias("x"))

    parts = [F.transform(spans_of(text, r), keyed(k)) for k, r in enumerate(rules.of("D") + rules.of("R"))]
    return F.transform(F.sort_array(F.concat(*parts)), lambda x: x["x"])


def _joined(left: Column, right: Column) -> Column:
    """Rule ids with a plus between, unless the right one is there."""
    return F.when(F.array_contains(F.split(left, r"\+"), right), left).otherwise(F.concat(left, F.lit("+"), right))


def resolve(spans: Column, text: Column) -> Column:
    """Sorted spans to spans apart from each other: neighbours with nothing but white space between fuse, overlapping
    ones merge; the rule of the stronger action, then of the longer span, names the result."""

    def pack_(s, e, rule, prio, category) -> Column:
        return F.struct(s.alias("s"), e.alias("e"), rule.alias("rule"), prio.alias("prio"), category.alias("category"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        gap = F.substring(text, cur["e"] + 1, x["s"] - cur["e"])
        apart = x["s"] >= cur["e"]
        fuse = apart & (F.regexp_replace(gap, r"(?U)\s+", "") == "")
        longer = (x["e"] - x["s"]) - (cur["e"] - cur["s"])
        won = F.when(x["prio"] > cur["prio"], x["rule"]).when(x["prio"] < cur["prio"], cur["rule"]).when(longer > 0, x["rule"]).when(longer < 0, cur["rule"]).otherwise(_joined(cur["rule"], x["rule"]))
        rule = F.when(fuse, _joined(cur["rule"], x["rule"])).otherwise(won)
        merged = pack_(cur["s"], F.greatest(cur["e"], x["e"]), rule, F.greatest(cur["prio"], x["prio"]), cur["category"])
        opens = cur.isNull() | (apart & ~fuse)
        return F.struct(F.when(opens, x).otherwise(merged).alias("cur"), F.when(opens & cur.isNotNull(), F.array_append(acc["out"], cur)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(None).cast(SPAN[6:-1]).alias("cur"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])))


def report(text: Column, resolved: Column) -> Column:
    """The report of a text from its resolved spans: sanitized_text, is_blocked, redactions, token_map.

    Tokens are numbered in order of first occurrence of the lower-cased value; audit-only spans stay in the text and
    come first among the redactions, without a placeholder.
    """

    def build(sp: Column) -> Column:
        with_text = F.transform(sp, lambda x: F.struct(x.alias("x"), F.substring(text, x["s"] + 1, x["e"] - x["s"]).alias("t")))
        hidden = F.filter(with_text, lambda y: y["x"]["prio"] > 1)
        low = F.transform(hidden, lambda y: F.lower(y["t"]))

        def named(parts: Column) -> Column:
            hid, ks, shown, low = parts["hid"], parts["ks"], parts["shown"], parts["low"]
            first = lambda k: F.element_at(hid, F.array_position(low, k).cast("int"))["x"]
            tokens = F.transform(ks, lambda k, i: let(first(k), lambda x: placeholder(x["rule"], x["category"], i + 1)))

            def done(tk: Column) -> Column:
                marked = F.transform(hid, lambda y: F.struct(y["x"].alias("x"), y["t"].alias("t"), F.element_at(tk, F.array_position(ks, F.lower(y["t"])).cast("int")).alias("token")))

                def out(m: Column) -> Column:
                    pieces = F.aggregate(
                        m,
                        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
                        lambda acc, y: F.struct(y["x"]["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, y["x"]["s"] - acc["at"]), y["token"])).alias("out")),
                        lambda acc: F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))), ""),
                    )
                    entry = lambda y, token: F.struct(
                        y["x"]["rule"].alias("rule_id"), action_of(y["x"]["prio"]).alias("action"), F.octet_length(F.left(text, y["x"]["s"])).cast("long").alias("offset"),
                        F.octet_length(y["t"]).cast("long").alias("length"), token.alias("placeholder"), y["x"]["category"].alias("category"),
                    )
                    last = let(F.reverse(low), lambda back: F.transform(ks, lambda k: F.element_at(hid, -F.array_position(back, k).cast("int"))["t"]))
                    return F.struct(
                        pieces.alias("sanitized_text"),
                        F.exists(hid, lambda y: y["x"]["prio"] == PRIORITY["Block"]).alias("is_blocked"),
                        F.concat(F.transform(shown, lambda y: entry(y, F.lit(""))), F.transform(m, lambda y: entry(y, y["token"]))).alias("redactions"),
                        F.map_from_arrays(tk, last).alias("token_map"),
                    )

                return let(marked, out)

            return let(tokens, done)

        return let(F.struct(hidden.alias("hid"), low.alias("low"), F.array_distinct(low).alias("ks"), F.filter(with_text, lambda y: y["x"]["prio"] == 1).alias("shown")), named)

    return let(resolved, build)


def sanitize(df: DataFrame, rules: RuleSet, column: str = "text") -> DataFrame:
    """df with ``report`` by the dictionary and regular-expression rules; null texts have a null report."""
    seen = df.withColumn("_visible", visible(F.col(column)))
    resolved = resolve(all_spans(F.col("_visible"), rules), F.col("_visible"))
    full = report(F.col("_visible"), resolved)
    return seen.withColumn("report", F.when(F.col("_visible").isNotNull(), full)).drop("_visible")


#: What a text without a match often lacks altogether, and one look finds out for all rules that need it.
NEEDED = {"digit": r"\p{Nd}", "at": "@"}


def needs(pattern: str) -> set[str]:
    """Which of ``NEEDED`` every match of a pattern holds."""
    from re import _constants as C, _parser as parser

    def digits(item: tuple) -> bool:
        op, value = item
        if op is C.RANGE:
            return ord("0") <= value[0] and value[1] <= ord("9")
        return (op is C.LITERAL and chr(value) in "0123456789") or (op is C.CATEGORY and value is C.CATEGORY_DIGIT)

    def of(items) -> set[str]:
        out: set[str] = set()
        for op, value in items:
            if op is C.LITERAL:
                out |= {"digit"} if digits((op, value)) else {"at"} if chr(value) == "@" else set()
            elif op is C.IN:
                out |= {"digit"} if all(map(digits, value)) else set()
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0]:
                out |= of(value[2])
            elif op is C.SUBPATTERN:
                out |= of(value[-1])
            elif op is C.BRANCH:
                out |= set.intersection(*map(of, value[1]))
        return out

    return of(parser.parse(pattern))


def _may_hold(rule: Rule) -> list[Column]:
    """What a text must have for a match of the rule (columns of ``_seen``)."""
    return [F.col(f"_has.{k}") for k in sorted(set() if rule.kind == "D" else needs(rule.pattern))]


def _seen(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_has", F.struct(*[F.col(column).rlike(p).alias(k) for k, p in NEEDED.items()]))


def rule_names(df: DataFrame, rules: list[Rule], column: str = "text") -> DataFrame:
    """The other columns and rule of each row of ``rule_hits``, where nobody asks for places: matches are not placed."""
    parts = []
    for r in rules:
        pattern = dictionary_pattern(r.pattern) if r.kind == "D" else java_pattern(r.pattern)
        may = reduce(lambda a, b: a & b, _may_hold(r), F.col(column).isNotNull())
        n = F.size(F.regexp_extract_all(column, F.lit(pattern), 0))
        parts.append(F.when(may, F.array_repeat(F.lit(r.id), n)).otherwise(F.array().cast("array<string>")))
    keep = [F.col(f"`{c}`") for c in df.columns if c != column]
    return _seen(df, column).select(*keep, F.explode(F.concat(*parts)).alias("rule"))


def rule_hits(df: DataFrame, rules: list[Rule], column: str = "text") -> DataFrame:
    """A row for each match (leftmost, not overlapping) of each rule: the other columns, rule, s, e, match.

    One scan looks for all rules; a rule that is nowhere in a text costs one search there, and none where the text lacks
    what the rule's matches need (``needs``).
    """
    text, none = F.col(column), F.array().cast("array<struct<rule:string,s:int,e:int>>")

    def tagged(rule_id: str):
        return lambda m: F.struct(F.lit(rule_id).alias("rule"), m["s"].alias("s"), m["e"].alias("e"))

    parts = []
    for r in rules:
        pattern = dictionary_pattern(r.pattern) if r.kind == "D" else java_pattern(r.pattern)
        may = reduce(lambda a, b: a & b, [*_may_hold(r), text.rlike(pattern)])
        parts.append(F.when(may, F.transform(matches(text, pattern), tagged(r.id))).otherwise(none))
    keep = [F.col(f"`{c}`") for c in df.columns if c != column]
    found = _seen(df, column).select(*keep, text, F.explode(F.concat(*parts)).alias("_m"))
    return found.select(*keep, "_m.rule", "_m.s", "_m.e", F.substring(text, F.col("_m.s") + 1, F.col("_m.e") - F.col("_m.s")).alias("match"))
