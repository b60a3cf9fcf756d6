"""Secret scans, all in DataFrame functions: spans of candidates, and how widely each candidate is owned.

Kinds: ``assign`` (a keyword given a value of 12 characters or more), ``access`` (AKIA..., 18 or more), ``hex`` (16 or more). Spans are in
code points, end exclusive. A text's matches and the text between them give the places: both come from the same left-to-right
search.

Over the whole corpus each candidate value (by hash) is counted by distinct repositories and distinct owners. One that is widely
copied is an example: EXAMPLE_SHARE of all owners hold it, two at least, and it stands in that share of all repositories, two at least
where there are two. Owners and repositories are counted apart, so neither needs to be part of the other; no fixed number is enough.
So is one of two owners or more that has a placeholder word. Any other belongs to those who hold it, few as they are; one that also
looks random (enough different characters, letters with digits, no placeholder word) is live-looking and its value is added as a span
of kind ``live``.

Null texts have no candidates. A null repository or owner counts as one of its own. Rows are told apart by a number given at the
scan, so repeated ids are no trouble.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep

# Fixed values of the scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "live")
PLACEHOLDERS = r"(?i)example|sample|changeme|placeholder|dummy|xxxx|your_?|1234567"
EXAMPLE_SHARE = 0.5
DISTINCT_CHARACTERS = 8
MASK = "<secret>"
SPAN = "struct<start:int,kind:int,end:int,value_start:int,value:string>"


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Array of spans of the pattern's matches whose value (a group at the match's end) has ``least`` characters or more."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def add(state, x):
        start, end = state.at + x.gap, state.at + x.gap + x["size"]
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (end - F.length(x["value"])).alias("value_start"), x["value"].alias("value")
        )
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state.found, F.array(span))).otherwise(state.found).alias("found"))

    found = F.aggregate(F.slice(steps, 1, F.size(whole)), empty, add, lambda s: s.found)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string")))
    return F.array_join(text, ",")


def looks_random(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, "")))
    return (different >= DISTINCT_CHARACTERS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDERS)


def scan(docs: DataFrame, repository: Column, owner: Column, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, owned): rows (row, doc, repository, owner, found) with the row of docs as a struct, and per row number with candidates
    (row, live, own, n_example): spans of live-looking values, of all values that are no examples, and how many are examples."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.concat(spans_of(text, ASSIGN, 0, 2, ASSIGN_LENGTH), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2))
    scanned = keep(
        docs.select(
            F.struct(*(docs[c] for c in docs.columns)).alias("doc"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), found.alias("found")
        ).withColumn("row", F.monotonically_increasing_id()),
        "scanned",
    )
    candidates = scanned.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("span")).select(
        "row", "repository", "owner", "span", F.sha2("span.value", 256).alias("hash")
    )
    holders = candidates.groupBy("hash", "repository", "owner").agg(
        F.max(looks_random(F.col("span.value"))).alias("random"), F.max(F.col("span.value").rlike(PLACEHOLDERS)).alias("placeholder")
    )
    missing = lambda c: F.max(F.when(F.col(c).isNull(), 1).otherwise(0))
    owned = keep(
        holders.groupBy("hash").agg(
            (F.countDistinct("owner") + missing("owner")).alias("owners"),
            (F.countDistinct("repository") + missing("repository")).alias("repositories"),
            F.max("random").alias("random"),
            F.max("placeholder").alias("placeholder"),
        ),
        "owned",
    )
    everyone = scanned.select("owner", "repository").distinct().agg(  # one row
        (F.countDistinct("owner") + missing("owner")).alias("all_owners"), (F.countDistinct("repository") + missing("repository")).alias("all_repositories")
    )
    share = lambda c: F.ceil(EXAMPLE_SHARE * F.col(c))
    widely = (F.col("owners") >= F.greatest(F.lit(2), share("all_owners"))) & (
        F.col("repositories") >= F.greatest(F.least(F.lit(2), F.col("all_repositories")), share("all_repositories"))
    )
    owned = owned.crossJoin(F.broadcast(everyone)).withColumn("example", widely | (F.col("placeholder") & (F.col("owners") >= 2)))
    example = F.col("example")
    value = F.struct(
        F.col("span.value_start").alias("start"), F.lit(3).alias("kind"), F.col("span.end").alias("end"), F.col("span.value_start").alias("value_start"), F.col("span.value").alias("value")
    )
    per_row = (
        candidates.select("row", "span", "hash")
        .join(owned, "hash")
        .groupBy("row")
        .agg(
            F.array_distinct(F.collect_list(F.when(~example & F.col("random"), value))).alias("live"),
            F.array_sort(F.array_distinct(F.collect_list(F.when(~example, value)))).alias("own"),
            F.count_if(example).alias("n_example"),
        )
    )
    return scanned, per_row


def secrets(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) per row of docs."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), repository.alias("repository"), owner.alias("owner"))
    scanned, per_row = scan(plain, F.col("repository"), F.col("owner"), "text")
    scanned = scanned.select("row", "doc.doc_id", "found")
    count = lambda k: F.size(F.filter("found", lambda s: s.kind == k)).cast("long")
    with_spans = scanned.where(F.size("found") > 0).join(per_row.drop("own"), "row")
    without = scanned.where(F.size("found") == 0).withColumns({"live": F.array().cast(f"array<{SPAN}>"), "n_example": F.lit(0).cast("long")})
    return with_spans.unionByName(without).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("found")), 256).alias("base_sha256"),
        joined(F.concat("found", "live")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        "n_example",
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with the spans (sorted by start) replaced; spans that overlap become one."""

    def add(state, s):
        upto = F.greatest(s.start, state.at)
        gap = F.concat(state.out, F.substr(text, state.at + 1, upto - state.at))
        out = F.when(s.end <= state.at, state.out).when(s.start < state.at, gap).otherwise(F.concat(gap, F.lit(mask)))
        return F.struct(F.greatest(s.end, state.at).alias("at"), out.alias("out"))

    end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return F.concat(end.out, F.substr(text, end.at + 1, F.length(text)))


def redacted(docs: DataFrame, repository: Column, owner: Column, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the values of few owners masked in the text, examples left; ``length_col``, where docs has it, is the new text's."""
    scanned, per_row = scan(docs, repository, owner, text_col)
    names = [f"doc.`{c}`" for c in docs.columns]
    clean = scanned.where(F.size("found") == 0).select(*(F.col(c) for c in names))
    text = F.col(f"doc.`{text_col}`")
    met = scanned.where(F.size("found") > 0).join(per_row, "row").withColumn("masked", F.when(F.size("own") > 0, masked(text, F.col("own"))).otherwise(text))
    new = {text_col: F.col("masked")} | ({length_col: F.when(F.size("own") > 0, F.length("masked")).otherwise(F.col(f"doc.`{length_col}`"))} if length_col in docs.columns else {})
    return clean.union(met.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns)))
