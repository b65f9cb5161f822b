"""Secret scans with multipart credential linking.

Base findings are the matches of three patterns. Weak candidates mean little alone, so they are reported only where their
complements co-occur, which an interval join over cells of text decides: an unlabelled secret-like string with an access
identifier whose scope it overlaps, as the two make a credential; an endpoint with an access identifier whose scope it
overlaps and which has a secret (labelled or not) in its scope too, as an endpoint completes a credential only.

Only DataFrame and SQL functions are used. Spans are in code points, the end exclusive. The pieces between matches come from
split() and the matches from regexp_extract_all(), which find the same ones, so that lengths add up to positions. Folds over
matches append to chunks and redaction cuts blocks, so that the time of a text grows with its length and its findings, not
with their square.

Cases: a null or empty text has no spans; documents that repeat a doc_id are scanned each, and those with the same text too
share what is linked; overlapping findings of several kinds are all reported and redacted as one; a text may hold any number
of findings; extra columns are ignored (redact keeps them); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.columns import let
from textloom.llm.common import stage, text_or_empty, unused

# The patterns of the base findings, and the least code points of the group that is measured.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
#: What a text must match for a pattern to be tried. A run of hex digits is found from its start, so short ones may be
#: skipped without moving a match.
GUARD = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
TRIED = {"assign": ASSIGN, "access": ACCESS, "hex": r"[0-9a-f]{24,}"}
#: Weak candidates, tried only in texts with an access identifier.
WEAK = {"secret": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", "endpoint": r"https?://[^\s\"'<>]+"}
KINDS = [*BASE, *WEAK]
#: How far the scope of an access identifier reaches on either side, in code points; the width of a cell.
SCOPE, CELL = 256, 512
SPAN = "struct<s:int,k:int,e:int>"
#: Items of a fold's chunk; code points of a block that redaction cuts pieces from.
CHUNK, PIECE = 512, 2048


def fold(items: Column, step, kind: str) -> Column:
    """Left fold over an array: step(at, x) gives the next at (int, from 0) and an array of none or one `kind` to put out.

    Gives a struct of the last `at` and `out`, all that was put out. Items go in chunks, as appending to an array copies it.
    """
    empty = lambda of: F.array().cast(f"array<{of}>")
    nested = let(items, lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / CHUNK).cast("int")), lambda i: F.slice(a, i * CHUNK + 1, CHUNK)))

    def one(acc: Column, x: Column) -> Column:
        at, more = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), empty(kind).alias("out")), one)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), empty(f"array<{kind}>").alias("out"))
    return let(F.aggregate(nested, start, chunk), lambda d: F.struct(d["at"].alias("at"), F.flatten(d["out"]).alias("out")))


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The spans of a pattern's matches whose group has at least `least` code points."""
    between, found, measured = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(F.zip_with(F.transform(between, F.length), F.transform(found, F.length), lambda a, b: F.struct(a.alias("skip"), b.alias("n"))), F.transform(measured, F.length), lambda x, m: F.struct(x["skip"].alias("skip"), x["n"].alias("n"), m.alias("m")))
    k = KINDS.index(kind)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        span = F.array(F.struct((at + x["skip"]).alias("s"), F.lit(k).alias("k"), (at + x["skip"] + x["n"]).alias("e"))).cast(f"array<{SPAN}>")
        return at + x["skip"] + x["n"], F.when(x["m"] >= least, span).otherwise(no_spans())

    # the piece after the last match has no match beside it
    return fold(F.filter(lengths, lambda x: x["n"].isNotNull()), step, SPAN)["out"]


def spelled(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))


def base_findings(text: Column) -> dict[str, Column]:
    """The spans of each base pattern in a text. The pattern is tried only where its guard matches."""
    return {k: F.when(text.rlike(GUARD[k]), spans_of(text, k, TRIED[k], group, least)).otherwise(no_spans()) for k, (_, group, least) in BASE.items()}


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def candidates(df: DataFrame) -> DataFrame:
    """(doc_id, key, same, base, weak) of every row of df. key is doc_id, or -1 for none; same tells texts of a key apart."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", *(v.alias(k) for k, v in base_findings(F.col("text")).items()))
    anchored = F.size("access") > 0
    weak = [F.when(anchored, spans_of(F.col("text"), k, p, 0, 1)).otherwise(no_spans()) for k, p in WEAK.items()]
    return rows.select("doc_id", key().alias("key"), F.xxhash64("text").alias("same"), F.array_sort(F.concat(*BASE)).alias("base"), F.concat(*weak).alias("weak"))


def linked(found: DataFrame) -> DataFrame:
    """(key, same, weak): the weak spans whose complements co-occur in the scope of an access identifier."""
    kind = {k: KINDS.index(k) for k in KINDS}
    rows = found.where("size(weak) > 0")
    over = lambda s, e: F.explode(F.sequence(F.floor(s / CELL), F.floor((e - 1) / CELL)))
    scopes = rows.select("key", "same", F.explode(F.filter("base", lambda x: x["k"] == kind["access"])).alias("x"))
    scopes = scopes.select("key", "same", F.greatest(F.col("x.s") - SCOPE, F.lit(0)).alias("lo"), (F.col("x.e") + SCOPE).alias("hi")).distinct()
    scopes = scopes.withColumn("cell", over(F.col("lo"), F.col("hi")))
    # labelled secrets complement endpoints, but are findings already
    parts = rows.select("key", "same", F.explode(F.concat("weak", F.filter("base", lambda x: x["k"] == kind["assign"]))).alias("x"))
    parts = parts.distinct().withColumn("cell", over(F.col("x.s"), F.col("x.e")))
    met = parts.join(scopes, ["key", "same", "cell"]).where((F.col("x.s") < F.col("hi")) & (F.col("lo") < F.col("x.e")))
    # a scope spans a few cells, so what is collected here is bounded by its width
    own = met.groupBy("key", "same", "lo", "hi").agg(F.collect_set("x").alias("xs"))
    paired = F.exists("xs", lambda x: x["k"] != kind["endpoint"])
    own = own.select("key", "same", F.filter("xs", lambda x: (x["k"] == kind["secret"]) | ((x["k"] == kind["endpoint"]) & paired)).alias("xs")).where("size(xs) > 0")
    return own.groupBy("key", "same").agg(F.array_distinct(F.flatten(F.collect_list("xs"))).alias("weak"))


def scan(df: DataFrame) -> DataFrame:
    """(doc_id, key, same, base, spans) of every row of df (doc_id, text): base findings, and all findings, by start and kind."""
    found = stage(candidates(df), "secrets")
    out = found.drop("weak").join(linked(found), ["key", "same"], "left")
    return out.select("doc_id", "key", "same", "base", F.array_sort(F.concat("base", F.coalesce("weak", no_spans()))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The findings of scan() as counts, digest and text."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """A text with its spans, sorted by start, replaced by a mark; overlapping ones by one."""
    gap = "struct<s:int,e:int>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        kept = F.array(F.struct(at.alias("s"), x["s"].alias("e"))).cast(f"array<{gap}>")
        return F.greatest(at, x["e"]), F.when(x["s"] >= at, kept).otherwise(F.array().cast(f"array<{gap}>"))

    def piece(blocks: Column, g: Column) -> Column:
        """The code points from g.s to g.e. Blocks are of PIECE code points, so no cut walks through the whole text."""
        first, last = F.floor(g["s"] / PIECE).cast("int"), F.floor((g["e"] - 1) / PIECE).cast("int")
        within = F.substring(F.get(blocks, first), g["s"] % PIECE + 1, g["e"] - g["s"])
        across = F.concat(F.substring(F.get(blocks, first), g["s"] % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(blocks, last), F.lit(1), (g["e"] - 1) % PIECE + 1))
        return F.when(g["s"] >= g["e"], "").when(first == last, within).otherwise(across)

    whole = let(fold(spans, step, gap), lambda x: F.concat(x["out"], F.array(F.struct(x["at"].alias("s"), F.greatest(x["at"], F.length(text)).alias("e"))).cast(f"array<{gap}>")))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    out = let(blocks, lambda b: F.array_join(F.transform(whole, lambda g: piece(b, g)), mark))
    return F.when(F.size(spans) == 0, text).otherwise(out)


def redact(df: DataFrame, mark: str = "[secret]") -> DataFrame:
    """df with every finding in its text replaced by a mark, and n_chars, if it has it, counted again.

    Only texts that may hold an access identifier can have linked findings. They alone are joined to what linking found;
    the others are redacted where they are read.
    """
    own, same, spans, clean = unused(df, "_key", "_same", "_spans", "_clean")
    text = text_or_empty()
    anchored = text.rlike(GUARD["access"])

    def done(rows: DataFrame, found: Column) -> DataFrame:
        out = rows.withColumn(clean, F.when(F.col("text").isNotNull(), masked(text, found, mark)))
        changed = {"text": F.col(clean)}
        if "n_chars" in df.columns:
            changed["n_chars"] = F.when(F.col(clean) == F.col("text"), F.col("n_chars")).otherwise(F.coalesce(F.length(clean), F.col("n_chars"))).cast(df.schema["n_chars"].dataType)
        return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns))

    plain = done(df.where(~anchored), F.array_sort(F.concat(*base_findings(text).values())))
    rest = df.where(anchored)
    found = scan(rest).where("size(spans) > 0").select(F.col("key").alias(own), F.col("same").alias(same), F.col("spans").alias(spans)).distinct()
    joined = rest.join(found, (key() == F.col(own)) & (F.xxhash64(text) == F.col(same)), "left")
    return plain.unionByName(done(joined, F.coalesce(spans, no_spans())))
