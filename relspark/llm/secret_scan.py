"""Secret scanning with multipart credential linking, in DataFrame functions only.

Base findings (``assign``, ``access``, ``hex``) stand alone. Weak candidates do not: an account name
(``id``), a short secret (``weak``), an unlabelled one (``bare``) or a service address (``endpoint``) is reported
only where complementary parts co-occur: within one scope, a stanza of lines without a blank line, a
identifier (``id`` or ``access``) and a secret (``weak``, ``bare``, ``assign`` or ``hex``) must lie within ``reach``
code points of each other; an endpoint must lie so near a secret that is linked.

Positions come from one ``regexp_replace`` a kind that brackets each match with a control character
that the text itself no longer holds (it is swapped beforehand for another control character, which no
pattern matches), a split, and running lengths, summed in blocks so that no array grows match by match. Of rows that
have parts of both sorts the spans, and nothing else, are dealt by row and joined as intervals in one sorted sweep: within a
scope a span has a partner in reach if the latest end among the partners before it, or the earliest start among those
behind it, is in reach. The cost follows the number of spans; no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import cut, id_and_text

# The base patterns of the contract, and the minimum lengths of their matches.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: Weak parts: names before a sign, short secrets before a sign, addresses.
ID = r"""(?i:access_?id|client_?id|account|login|username|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
WEAK = r"""(?i:password|passwd|passphrase|pwd|secret|credential|auth|key|token)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
ENDPOINT = r"""[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"""

#: Unlabelled secrets: long tokens with a digit, or with a capital after a small letter. The latter is sought from
#: the first small letter alone: from each of them, a long token without capitals takes time quadratic in its length.
BARE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MIXED = r"[0-9]|^[^a-z]*[a-z][^A-Z]*[A-Z]"

#: What parts two scopes.
BLANK = r"\n[\x20\x09\x0B-\x0D]*\n"

MARK, SWAP = "\x01", "\x02"


SPANS = "array<struct<start:int,end:int,kind:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is, an expression used twice need not be."""
    return F.transform(F.array(value), body)[0]


def running_lengths(pieces: Column) -> Column:
    """The sum of the lengths up to the end of each piece: ``array<int>``.

    Appending to an array copies it, so about ``sqrt(n)`` blocks of as many lengths are summed by themselves.
    """

    def add(state: Column, length: Column) -> Column:
        at = state["at"] + length
        return F.struct(at.alias("at"), F.concat(state["all"], F.array(at)).alias("all"))

    def summed(lengths: Column, start: Column) -> Column:
        return F.aggregate(lengths, F.struct(start.alias("at"), F.array().cast("array<int>").alias("all")), add, lambda s: s["all"])

    def in_blocks(lengths: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(lengths))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / width).cast("int") - 1), lambda b: F.slice(lengths, b * width + 1, width))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return F.flatten(F.zip_with(blocks, F.slice(F.concat(F.array(F.lit(0)), summed(totals, F.lit(0))), 1, F.size(blocks)), summed))

    return let(F.transform(pieces, lambda p: F.length(p)), lambda lengths: let(in_blocks(lengths), joined))


def spans_of(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<start, end, kind>>`` of the leftmost non-overlapping matches, in code points.

    ``keep`` is a function of the matched text; matches it denies are dropped after matching.
    """

    def matches(pieces: Column, ends: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), lambda i: F.struct(ends[i - 1].alias("start"), ends[i].alias("end"), pieces[i].alias("text")))
        kept = F.filter(found, lambda x: keep(x["text"])) if keep is not None else found
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    named = let(pieces, lambda p: let(running_lengths(p), lambda ends: matches(p, ends)))
    return F.when(text.rlike(pattern), named).otherwise(F.array().cast(SPANS))


def joined_spans(spans: Column, order: list[str]) -> Column:
    """``kind:start:end`` by start, then kind in ``order``, comma-joined."""
    ranked = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, order)), x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


#: Order of spans that begin at one place: what a later test must have behind it comes first, a scope's end last.
FIRST, LAST = ("hex",), ("break",)


def link_parts(spans: DataFrame, reach: int, unlabelled: bool) -> DataFrame:
    """The linked parts that are no base findings, ``key, start, end, kind``, of spans with the same columns.

    Spans of a key are one row's; those of kind ``break`` part its scopes.
    """
    rank = F.when(F.col("kind").isin(*FIRST), 0).when(F.col("kind").isin(*LAST), 2).otherwise(1)
    spans = spans.distinct().withColumn("rank", rank)
    order = ["start", "rank", "kind", "end"]
    row, scope = ["key"], ["key", "scope"]

    def before(group: list[str], test: Column) -> Column:
        over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.max(F.when(test, F.col("end"))).over(over), F.lit(-1))

    def behind(group: list[str], test: Column) -> Column:
        # downwards, as a frame that grows is one pass and one that shrinks is not
        over = Window.partitionBy(*group).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.min(F.when(test, F.col("start"))).over(over), F.lit(2**31 - 1))

    def overlaps(*kinds: str) -> Column:
        test = F.col("kind").isin(*kinds)
        return (before(row, test) > F.col("start")) | (behind(row, test) < F.col("end"))

    def within_reach(test: Column) -> Column:
        return (before(scope, test) >= F.greatest(F.col("start") - reach, F.lit(0))) | (behind(scope, test) <= F.col("end").cast("long") + reach)

    kind = F.col("kind")
    secret = kind.isin("assign") | (kind == "weak") & ~overlaps("assign")
    if unlabelled:
        address = (before(row, kind == "endpoint") >= F.col("start")) | (behind(row, kind == "endpoint") < F.col("end"))
        bare = (kind == "bare") & ~overlaps("assign", "access", "id", "weak") & ~(before(row, kind == "hex") >= F.col("end")) & ~address
        secret = secret | bare | (kind == "hex") & ~overlaps("id")
    scopes = F.coalesce(F.sum((kind == "break").cast("int")).over(Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spans.select("*", scopes.alias("scope"), secret.alias("secret")).filter("kind <> 'break'")
    name = kind.isin("id", "access")
    linked = placed.select("*", (name & within_reach(F.col("secret"))).alias("linked_name"), (F.col("secret") & within_reach(name)).alias("linked_secret"))
    found = linked.select("*", ((kind == "endpoint") & within_reach(F.col("linked_secret"))).alias("linked_place"))
    return found.filter((F.col("linked_name") | F.col("linked_secret") | F.col("linked_place")) & kind.isin("id", "weak", "bare", "endpoint")).select("key", "start", "end", "kind")


def scan_secrets(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text", unlabelled: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, assign, access, hex, linked``, arrays of (start, end, kind).

    Null text counts as empty and has no findings. Ids are integers, or strings of such, or null. Repeated rows are reported alike;
    an empty table gives no rows; other columns are not read. Very long texts are read whole. Of a weak and a base secret that
    overlap only the base one is reported, of a bare token and any other finding the other; spans that begin at one place are all
    reported. ``linked`` holds, by start, ``id``, ``weak``, ``bare`` and ``endpoint`` spans of linked credentials. Without
    ``unlabelled``, neither bare tokens nor hex spans are secrets to link with.
    """
    text, none = F.col("text"), F.array().cast(SPANS)
    clean = id_and_text(docs, id_col, text_col).select("doc_id", F.translate("text", MARK, SWAP).alias("text"))
    found = clean.select(
        "doc_id",
        "text",
        spans_of(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN).alias("assign"),
        spans_of(text, ACCESS, "access", lambda m: F.length(m) >= MIN_ACCESS).alias("access"),
        spans_of(text, HEX, "hex").alias("hex"),
        spans_of(text, ID, "id").alias("id"),
        spans_of(text, WEAK, "weak").alias("weak"),
    )
    secrets = F.size("weak") + F.size("assign") > 0
    pair = (F.size("id") + F.size("access") > 0) & (secrets if not unlabelled else secrets | (F.size("hex") > 0) | text.rlike(BARE))
    paired = found.withColumn("pair", pair)
    more = [spans_of(text, ENDPOINT, "endpoint"), spans_of(text, BLANK, "break")]
    if unlabelled:
        more.append(spans_of(text, BARE, "bare", lambda m: m.rlike(MIXED)))
    parts = F.when(F.col("pair"), F.concat("assign", "access", "hex", "id", "weak", *more)).otherwise(none)
    key = F.when(F.col("pair"), F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    rows = cut(paired.select("doc_id", "assign", "access", "hex", key.alias("key"), parts.alias("parts")))
    spans = rows.filter("key is not null").select("key", F.explode("parts").alias("part")).select("key", "part.*")
    links = link_parts(spans, reach, unlabelled).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("linked"))
    base = ["doc_id", "assign", "access", "hex"]
    alone = rows.filter("key is null").select(*base, none.alias("linked"))
    joined = rows.filter("key is not null").join(links, "key", "left").select(*base, F.coalesce("linked", none).alias("linked"))
    return alone.unionByName(joined)
