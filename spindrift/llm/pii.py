"""Personal data, natively: base patterns, and contextual extraction bootstrapped from what they find.

Base: e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers, leftmost and non-overlapping per
kind. Positions are in code points: the pieces between matches come from the same pattern, and running lengths
of pieces and matches give each match's start. Quantifiers are possessive where that changes nothing, so long
texts neither backtrack nor recurse; matches that fail their kind's test are dropped, without another try.

Extraction: every base entity, and every other token that looks like an identifier (it holds a digit or an at sign,
or is made of groups of digits), is an instance with lexical patterns: the three words before it, and the word before
it where that ends like a cue (``phone:``, ``id=``). Known instances (at first the base entities) score the patterns of the
pattern-instance graph; a pattern that at least ``support`` distinct known values of a kind, from as many
documents, confirm, and at least ``confidence`` of whose distinct values are known of that kind, makes the other
tokens that it extracts known instances too, for the next round. Rounds go on until none finds a new value. All
occurrences of what was found, under whatever context, are spans beside the base ones, unless they overlap one.

All is DataFrame and SQL functions. The graph is aggregated by pattern and value before patterns are judged, so a
hot pattern or value is a sum, not a group in one task; tables between rounds are written to the shared folder.

Defined cases: a null text is an empty one; a very long one is one row, in which each token is held against each base
span, and matches are placed by a fold over them; null and repeated ids stay as they are, rows never mix; an empty table
gives an empty result; other columns pass through, those named like new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm._store import materialise, release, scope

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Names of the columns of base spans meanwhile.
_INNER = {k: f"_spans_{k}" for k in KINDS}
#: Base patterns. A match can only start where a run of its first characters starts, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?=(?:[ -]?[0-9]){12})[0-9]*+(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A token that looks like an identifier: groups of digits joined by single separators or brackets, with seven digits at
#: least; or an unbroken token that has a digit or an at sign within.
TOKEN = (
    r"(?<![A-Za-z0-9@._+/-])(?:(?=(?:[+( ./)-]*+[0-9]){7})[+]?+[(]?+[0-9]++[)]?+(?:[ ./-]?+[(]?+[0-9]++[)]?+)++(?![A-Za-z0-9@_+/-])"
    r"|(?=[A-Za-z._+/-]*+[0-9@])[A-Za-z0-9@._+/-]++)"
)
#: Characters before an instance in which its last three words are looked for first; all before it where these don't do.
_BEFORE = 80


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """The kind's own test of a match."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce((F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255), F.lit(False)))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _tester(kind: str):
    return lambda x: _holds(kind, x["value"])


def _instances(column: str, kind: str | None, text: Column) -> Column:
    """Spans of one kind (or of none) with their lexical patterns."""
    own = F.lit(kind).cast("string")
    return F.transform(column, lambda x: F.struct(own.alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), _contexts(text, x["start"]).alias("patterns")))


def _found(text: Column, pattern: str, matches: Column) -> Column:
    """array<struct<start, stop, value>> of the matches, in code points."""
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("stop"), x["value"].alias("value")))).alias("spans"))

    # The last piece follows the last match and has none.
    counted = F.filter(lengths, lambda x: x["value"].isNotNull())
    return F.when(F.size(matches) > 0, F.aggregate(counted, start, add, lambda acc: acc["spans"])).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string>>"))


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a column ``_spans_<kind>`` of each kind: array<struct<start, stop, value>>, and ``_tokens``, the same for identifier-like
    tokens that overlap none of them. The text column is replaced by itself with null as empty."""
    text = F.col(text_col)
    docs = docs.withColumn(text_col, F.coalesce(text, F.lit("")))
    guards = {"email": F.instr(text, "@") > 0, "ip": F.instr(text, ".") > 0, "card": F.lit(True), "phone": F.instr(text, "+") > 0}
    none = F.array().cast("array<string>")
    raw = docs.withColumns({f"_{k}": F.when(guards[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS} | {"_tokens": F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))})
    placed = raw.withColumns({_INNER[k]: F.filter(_found(text, PATTERNS[k], F.col(f"_{k}")), _tester(k)) for k in KINDS} | {"_tokens": _found(text, TOKEN, F.col("_tokens"))})
    every = F.concat(*_INNER.values())
    # Full stops and the like that end a token aren't part of it.
    trimmed = F.transform("_tokens", lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(F.regexp_replace(x["value"], r"[._+/-]+$", ""))).alias("stop"), F.regexp_replace(x["value"], r"[._+/-]+$", "").alias("value")))
    apart = F.filter(trimmed, lambda x: (x["stop"] > x["start"]) & ~F.exists(every, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return placed.withColumn("_tokens", F.when(F.size("_tokens") > 0, apart).otherwise(F.col("_tokens"))).drop(*(f"_{k}" for k in KINDS))


def _contexts(text: Column, start: Column) -> Column:
    """The lexical patterns of an instance: the three words before it, and a cue. Words are whole, however long."""
    space = r"[ \t\n\x0B\f\r]+"
    at = F.greatest(start - _BEFORE, F.lit(0))

    def words(part: Column) -> Column:
        return F.split(F.lower(part), space)

    def whole(w: Column) -> Column:
        """The words of the near text if three of them are surely whole: its first may have been cut."""
        near = F.filter(F.when(at > 0, F.slice(w, 2, 1000)).otherwise(w), lambda x: x != "")
        return F.when((at == 0) | (F.size(near) >= 3), near).otherwise(F.filter(words(F.substring(text, F.lit(1), start)), lambda x: x != ""))

    def patterns(w: Column) -> Column:
        n, last = F.size(w), F.element_at(w, -1)
        three = F.when(n >= 3, F.concat_ws(" ", F.slice(w, F.greatest(n - 2, F.lit(1)), 3)))
        cue = F.when((n >= 1) & last.rlike(r"[\p{L}]{2,}[:=#(\[\"']*[:=#]+[(\[\"']*$"), F.concat(F.lit("cue "), F.regexp_replace(last, r"[(\[\"']+$", "")))
        return F.filter(F.array(three, cue), lambda p: p.isNotNull())

    # Arrays of one element name what is used more than once.
    near = F.transform(F.array(words(text.substr(at + 1, start - at))), whole)
    return F.element_at(F.transform(near, patterns), 1)


def bootstrap(occurrences: DataFrame, rounds: int | None = None, support: int = 5, confidence: float = 0.8, row_col: str = "_row") -> DataFrame:
    """Row, kind, start, stop of the occurrences of what accepted patterns discover, in rounds until no value is new
    (or at most ``rounds``). Patterns and values once accepted stay, with their kinds."""
    values = materialise(occurrences.where("pattern IS NOT NULL").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    known = materialise(occurrences.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")), "known")
    accepted = discovered = None
    done = 0
    while rounds is None or done < rounds:
        done += 1
        graph = values.select("pattern", "value").join(known, "value", "left")
        per_kind = graph.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
        judged = per_kind.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("best"))
        judged = judged.where((F.col("best.n") >= support) & (F.col("best.n") >= confidence * F.col("all"))).select("pattern", F.col("best.kind").alias("as_kind"))
        judged = materialise(judged if accepted is None else judged.join(accepted.select("pattern"), "pattern", "left_anti"), "judged")
        # Documents of the known values of the kind, each counted once.
        confirmed = graph.join(judged, "pattern").where("kind = as_kind").select("pattern", "value", "as_kind")
        seen = occurrences.select("pattern", "value", row_col).join(confirmed, ["pattern", "value"]).select("pattern", "as_kind", row_col).distinct()
        fresh = materialise(seen.groupBy("pattern", "as_kind").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= support).select("pattern", "as_kind"), "patterns")
        more = values.where("kind IS NULL").join(fresh, "pattern").join(known.select("value"), "value", "left_anti")
        more = materialise(more.groupBy("value").agg(F.min("as_kind").alias("kind")), "values")
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        discovered = more if discovered is None else discovered.unionByName(more)
        if more.isEmpty():
            break
        known = materialise(known.unionByName(more), "known")
    open_ = occurrences.where("kind IS NULL")
    columns = [row_col, "start", "stop", "as_kind"]
    hits = open_.join(accepted, "pattern").select(*columns).unionByName(open_.join(discovered.withColumnRenamed("kind", "as_kind"), "value").select(*columns))
    return hits.groupBy(row_col, "start", "stop").agg(F.min("as_kind").alias("kind"))


def span_list(spans: Column) -> Column:
    """``kind:start:stop`` of an array of spans, in the order of kinds and starts, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(F.lit(list(KINDS)), x["kind"]).alias("k"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame, rounds: int | None = None, support: int = 5, confidence: float = 0.8, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``base`` and ``spans``: array<struct<kind, start, stop>>, of base entities and of all, each in order.

    Without ``keep_text`` the text column is dropped.
    """
    rows = docs.drop("base", "spans", "_row", "_tokens").withColumn("_row", F.monotonically_increasing_id())
    found = base_spans(rows, text_col)
    context = F.concat(*(_instances(_INNER[k], k, F.col(text_col)) for k in KINDS), _instances("_tokens", None, F.col(text_col)))
    found = found.withColumn("_all", context).drop("_tokens", *_INNER.values())
    found = materialise(found if keep_text else found.drop(text_col), "found")
    with scope() as tables:
        every = found.select("_row", F.explode("_all").alias("_x")).select("_row", "_x.kind", "_x.start", "_x.stop", "_x.value", F.explode_outer("_x.patterns").alias("pattern"))
        more = bootstrap(materialise(every, "occurrences"), rounds, support, confidence)
        more = materialise(more.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("_more")), "discovered")  # of one document
    release(docs.sparkSession, tables, keep=(more,))
    base = F.transform(F.filter("_all", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    empty = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    kept = [c for c in docs.columns if c not in ("base", "spans", "_row", "_tokens", *([] if keep_text else [text_col]))]
    return found.join(more, "_row", "left").withColumn("base", base).withColumn("spans", F.concat("base", F.coalesce("_more", empty))).select(*kept, "base", "spans")


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Replaces each span of the text by ``<KIND>``; where spans overlap, the one that starts first covers both."""
    order = F.array_sort(F.transform(spans_col, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = text.substr(acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, start, put, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans_col) > 0, done).otherwise(text))
