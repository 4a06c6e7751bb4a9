"""Secret scans over a ledger of content-addressed texts.

Every version of every document is known by the SHA-256 of its text (its blob). The ledger is a folder of Parquet
batches with one row per blob: which rules, in which versions, were run on it, and what they found. A scan reads the
text of each blob once, and of those only the blobs for which some current rule is not in the ledger; findings then
go back to all documents with that blob by a join. A batch is written by one Parquet commit, so a batch that was cut
short leaves no row and its blobs count as unseen.

All work is done by DataFrame functions. A regular expression cuts a text into what lies between the matches
(``split``) and the matches (``regexp_extract_all``); running sums of their lengths are the places of the matches.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrylog.llm.common import free_name
from ferrylog.operators.skew import lookup_join
from ferrylog.session import materialise


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches from left to right, none overlapping another of the same rule; a match counts if its
    group ``measured`` (0: all of it) has ``least`` characters or more. The span is the match, or its group ``ending``, with which it
    ends. Patterns must take time in proportion to the text. Change ``version`` with any of these."""

    kind: str
    version: int
    pattern: str
    measured: int
    least: int
    ending: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # runs are whole, so asking for 16 finds what dropping shorter runs leaves
)
_CODE, _GAP, _END = "[A-Za-z0-9+/=]", r"""[ \t\r\n"'#*>|;,%!\\+/nr-]""", "-----END [A-Z ]{0,30}PRIVATE KEY-----"
#: What follows the head of a private key: all up to its END line, if no other run of five dashes comes before; else header
#: fields, up to 434 runs of 16 base64 characters or more with line ends and marks of comments and strings between (a key of
#: 32,768 bits has 386), and a short last line. Loops over groups are bounded, for Java's matcher takes stack for each turn.
_KEY_BODY = (
    rf"(?:[^-]*(?:-{{1,4}}[^-]+){{0,250}}{_END}"
    rf"|(?:{_GAP}+[A-Z][A-Za-z-]+:[^\n]+){{0,4}}{f'(?:{_GAP}+{_CODE}{{16,}}){{0,62}}' * 7}"
    rf"""(?:{_GAP}+{_CODE}{{1,15}}[ \t\r"',;\\+nr]*(?:\n|\z))?(?:{_GAP}*{_END})?)"""
)
_RUN = "[A-Za-z0-9_-]"
#: What the scan looks for besides: signed web tokens and private keys. A token starts at the first ``eyJ`` of a run that two more follow;
#: whether they do is asked once per run, so a long run of ``eyJ`` is not searched from each of them.
MORE_RULES = (
    Rule("jwt", 2, rf"(?<!{_RUN})(?={_RUN}++\.eyJ{_RUN}++\.{_RUN}){_RUN}*?(eyJ{_RUN}++\.eyJ{_RUN}++\.{_RUN}++)", 1, 30, ending=1),
    Rule("pem", 2, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----" + _KEY_BODY, 0, 20),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<start:int,place:int,kind:string,stop:int,key:string>"
LEDGER = f"blob binary, ran array<string>, found array<{SPAN}>"
REDACTED = "[SECRET]"


def blob_of(text: Column) -> Column:
    """The content address of a text (SHA-256, 32 bytes); null is read as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _matches(rule: Rule, place: int, text: Column) -> Column:
    """A struct of the rule and, per match, the lengths of its span, of the stretch before it, of itself and of what is measured."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.measured))
    ending = F.regexp_extract_all(text, pattern, F.lit(rule.ending))
    between = F.split(text, rule.pattern, -1)
    lengths = F.arrays_zip(
        F.transform(ending, lambda x: F.length(x)).alias("kept"),
        F.transform(between, lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("size"),
        F.transform(measured, lambda x: F.length(x)).alias("counted"),
    )
    return F.when(
        text.rlike(rule.pattern),
        F.struct(F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("key"), F.lit(rule.least).alias("least"), lengths.alias("lengths")),
    )


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, ran, found`` of distinct blobs given with ``_text`` and ``ran``, the keys of the rules to run."""
    tries = [F.when(F.array_contains("ran", rule.key), _matches(rule, i, F.col("_text"))) for i, rule in enumerate(rules)]
    hits = blobs.select("blob", "ran", F.explode_outer(F.filter(F.array(*tries), lambda x: x.isNotNull())).alias("hit"))
    each = hits.select("blob", "ran", "hit.place", "hit.kind", "hit.key", "hit.least", F.posexplode_outer("hit.lengths").alias("i", "n"))
    # the stretch after the last match comes as a row without a match and is left out below
    upto = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("stop", F.sum(F.col("n.gap") + F.coalesce("n.size", F.lit(0))).over(upto).cast("int"))
    span = F.struct((F.col("stop") - F.col("n.kept")).alias("start"), "place", "kind", "stop", "key")
    return placed.groupBy("blob").agg(
        F.first("ran").alias("ran"),
        F.sort_array(F.collect_list(F.when(F.col("n.counted") >= F.col("least"), span))).cast(f"array<{SPAN}>").alias("found"),
    )


def read_ledger(spark, folder: str) -> DataFrame:
    """All batches of a ledger; a folder without any is an empty ledger."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS"))
    if not found:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*[x.getPath().getParent().toString() for x in found])


def scan_into(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Run each rule on each blob of ``versions`` that the ledger in ``folder`` does not say it was run on.

    Null texts count as empty. Copies of a text are one blob, reduced before the shuffle; no rows, no findings.
    Columns other than ``text`` are not looked at. Addresses go to the ledger first; then the texts of unseen blobs move, and no others
    as long as there are few enough of these to tell every task.
    """
    spark = versions.sparkSession
    current = F.array(*[F.lit(r.key) for r in rules])
    texts = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ledger = read_ledger(spark, folder)
    if ledger.isEmpty():
        unseen = texts.withColumn("ran", current)
    else:
        ran = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("ran"))).alias("seen"))
        todo = texts.select("blob").distinct().join(ran, "blob", "left").select("blob", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))).alias("ran"))
        unseen = lookup_join(texts, materialise(todo.where(F.size("ran") > 0), "unseen"), ["blob"], ["blob", "_text"])
    blobs = unseen.groupBy("blob").agg(F.first("_text").alias("_text"), F.first("ran").alias("ran"))
    _scan(blobs, rules).write.parquet(f"{folder}/batch={uuid.uuid4().hex}")


def findings(spark, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, found``: the spans of the current rules, by start and then rule, of each blob that has any."""
    keys = [r.key for r in rules]
    spans = read_ledger(spark, folder).where(F.size("found") > 0).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    return spans.select("blob", F.array_sort(F.array_distinct(F.filter("found", lambda x: x.key.isin(keys)))).alias("found")).where(F.size("found") > 0)


def stretches(spark, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, found``: what the spans of each blob cover, as stretches (start, stop) in order; spans that overlap or touch are one."""
    keys = [r.key for r in rules]
    spans = read_ledger(spark, folder).select("blob", F.explode("found").alias("s")).where(F.col("s.key").isin(keys)).select("blob", "s.start", "s.stop")
    before = Window.partitionBy("blob").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("blob").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int")
    merged = spans.withColumn("_opens", opens).withColumn("_number", F.sum("_opens").over(upto)).groupBy("blob", "_number").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("found"))


def with_findings(
    versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text: str = "text", found: str = "_found", merged: bool = False
) -> DataFrame:
    """All rows and columns of ``versions`` and ``found``, a name they do not have: the spans in that row's text (empty: none), or with
    ``merged`` the stretches that these cover.

    Rows of equal text all get the findings; the join's hot blobs are left to adaptive skew joins, the side with the
    findings having one row per blob.
    """
    key, spans = free_name(versions, "_blob"), free_name(versions, "_known")
    # written first: a plain join on both sides' own shuffles is one whose hot blobs can be split
    told = (stretches if merged else findings)(versions.sparkSession, folder, rules)
    known = materialise(told, "findings").select(F.col("blob").alias(key), F.col("found").alias(spans))
    joined = versions.withColumn(key, blob_of(F.col(text))).join(known, key, "left")
    return joined.select(*versions.columns, F.coalesce(known[spans], F.array().cast(told.schema["found"].dataType)).alias(found))


def _of(kind: str):
    return lambda x: x.kind == kind


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))), ",")


def secret_report(versions: DataFrame, folder: str, carried: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Scan, then one row per version: counts and a digest of the base findings, and all spans as text.

    Places are code points, the end exclusive. A null or empty text has no findings; equal rows give equal rows; an
    empty table gives none.
    """
    scan_into(versions, folder, RULES, text)
    found, base = F.col("_found"), [r.kind for r in BASE_RULES]
    rows = with_findings(versions.select(*carried, text), folder, RULES, text)
    counts = [F.size(F.filter(found, _of(kind))).cast("long").alias(f"n_{kind}") for kind in base]
    digest = F.sha2(spans_text(F.filter(found, lambda x: x.kind.isin(base))), 256).alias("base_sha256")
    return rows.select(*carried, *counts, digest, spans_text(found).alias("spans"))


#: Characters per chunk of a text that is redacted; a place in a chunk is found by counting from its start.
CHUNK = 1024


def redact(rows: DataFrame, text: str = "text", mark: str = REDACTED, found: str = "_found") -> DataFrame:
    """``rows`` with ``found`` (stretches, of :func:`with_findings` with ``merged``) dropped and every stretch of the text replaced by ``mark``.

    Null texts stay null. What lies between stretches is put together from chunks of the text, so that each costs its own length and at most
    two chunks; chunks are cut from pieces of ``CHUNK`` chunks, since a place in a text is found by counting characters.
    """
    columns, names = [c for c in rows.columns if c != found], ("_chunks", "_gaps", "_tail")
    chunks, gaps, tail = (free_name(rows, n) for n in names)
    whole, size = F.col(text), F.lit(CHUNK)
    cut = lambda s, each: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(s) - 1) / each), F.lit(0)).cast("int")), lambda i: F.substring(s, i * each + 1, each))
    pieces = F.flatten(F.transform(cut(whole, F.lit(CHUNK * CHUNK)), lambda piece: cut(piece, size)))
    # from the end of a stretch to the start of the next one; the first gap starts with the text
    ends = F.concat(F.array(F.lit(0)), F.transform(found, lambda x: x.stop))
    between = F.transform(F.arrays_zip(F.slice(ends, 1, F.size(found)).alias("a"), F.transform(found, lambda x: x.start).alias("b")), lambda x: F.struct(x.a.alias("a"), x.b.alias("b")))
    some = F.size(found) > 0
    made = F.struct(F.when(some, pieces).alias(chunks), F.when(some, between).alias(gaps), F.element_at(ends, -1).alias(tail))
    rows = rows.select("*", F.inline(F.array(made)))  # generated rows, so that chunks are cut once however often they are named

    def kept(a: Column, b: Column) -> Column:
        """The text from place ``a`` to place ``b``."""
        of = lambda p: F.floor(p / size).cast("int")
        first, last, start = of(a), of(b), a % size
        inner = F.array_join(F.slice(F.col(chunks), first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        head = F.substring(F.get(F.col(chunks), first), start + 1, F.least(b - a, size))
        end = F.coalesce(F.substring(F.get(F.col(chunks), last), F.lit(1), b % size), F.lit(""))
        return F.when(b <= a, F.lit("")).when(first == last, head).otherwise(F.concat(head, inner, end))

    marked = F.array_join(F.transform(gaps, lambda x: F.concat(kept(x.a, x.b), F.lit(mark))), "")
    new = F.when(F.col(gaps).isNull(), whole).otherwise(F.concat(marked, kept(F.col(tail), F.length(whole))))
    return rows.select(*[new.alias(c) if c == text else F.col(c) for c in columns])
