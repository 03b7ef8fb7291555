"""Personal data: plain patterns as seeds, and bootstrapped contextual extraction of further identifiers.

One scan finds the seeds and every other identifier-like token, each with its lexical patterns, the one to three
words before it and behind it.  Patterns and tokens (instances) form a graph that Spark scores in rounds: a pattern is
as sure as its instances are known and as its words stand beside nothing else, an instance as its patterns together,
less where tokens of its form mostly stand elsewhere.  Instances of sure patterns are seeds of the next round.  In the
end they are reported wherever they occur, as kind ``context``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, id_and_text, materialize, release, slices, utf8
from leafmill.llm.hashing import mix, text_words
from leafmill.llm.spans import SPAN_SQL, SPAN_TYPE, Span, joined_column, sha256

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs of digits can only match from their start, so the looking behind spares every other attempt
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")  # possessive: nothing is kept of the steps of a long run
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")
#: An identifier-like token: with a digit, of at least so many code points between the marks around it.
TOKEN_CHARS = 5
MARKS = ".,;:!?()[]{}<>\"'"
#: Forms of tokens that say a time, a date, an amount, a version, a measure or a range, and so nobody's name.
ORDINARY = re.compile(
    r"""\d{1,2}[:.]\d\d(?:[:.]\d\d)?(?:[ap]\.?m)? | \d{1,2}(?:[ap]m|h\d{0,2})
    | \d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:T[\d:.+Z-]*)? | \d{1,2}[-/.][a-z]{3,9}[-/.]\d{2,4}
    | [-+~]?[$\u20ac\xa3\xa5]?\d{1,3}(?:[,.']\d{3})+(?:[.,]\d+)? | [-+~]?[$\u20ac\xa3\xa5]?\d+[.,]\d{1,4} | [-+~]?[$\u20ac\xa3\xa5]\d+ | [-+~]?\d[\d.,']*[%$\u20ac\xa3\xa5\xb0]
    | v\d+(?:\.\d+)* | v?\d+(?:\.\d+){1,3}(?:[-+]?[a-z]+\.?\d*)?
    | \d[\d.,]*-?(?:st|nd|rd|th|mm|cm|m|km|mg|g|kg|ml|l|s|ms|min|h|hz|khz|mhz|ghz|w|kw|v|kb|mb|gb|tb|px|p|fps|kmh|mph|x|usd|eur|gbp)
    | \d{1,4}[-/\u2013]\d{1,4} | \d+x\d+""",
    re.X | re.I,
)
#: Words on either side that make a pattern, at most.
WORDS = 3
#: What an instance that is neither known nor accepted counts against a pattern; an ordinary word there counts 1.
UNKNOWN = 0.25
#: Bits of the map by which tasks pass over word sequences that no pattern asks for, as a power of two.
MAP_BITS = 24
#: Sequences whose counts a task holds.
HELD = 1 << 19
#: Code points and places of a text that are worked through at once.
SLICE, PLACES = 1 << 18, 4096


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, walking back from each @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at)  # no match begins before this @
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(a, 0, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return out


def candidates(clean: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit that no base span touches, without the marks around them, and of no ordinary form."""
    done, taken = 0, sorted((s[0], s[2]) for s in base)
    k, reach = 0, -1
    for m in DIGITS.finditer(clean):
        if m.start() < done:
            continue
        start = clean.rfind(" ", done and done - 1, m.start()) + 1 or done
        end = clean.find(" ", m.end())
        end = done = len(clean) if end < 0 else end
        token = clean[start:end]
        start += len(token) - len(token.lstrip(MARKS))
        end -= len(token) - len(token.rstrip(MARKS))
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if end - start >= TOKEN_CHARS and reach <= start and not (end - start < 40 and ORDINARY.fullmatch(clean, start, end)):
            yield start, end


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_UPPER, _LETTERS, _RUN = re.compile("[A-Z]+"), re.compile("[^\\W\\d_]+"), re.compile("[0-9]+")


def form(token: str) -> str:
    """A token's form: letters as ``a`` (``A`` where all of a run are capitals of A to Z), digits by their number, marks as they are."""
    parts = _LETTERS.sub(lambda m: "A" if _UPPER.fullmatch(m[0]) else "a", token[:200])
    return _RUN.sub(lambda m: f"9{{{len(m[0])}}}", parts)


def sequences(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of one, two and more words in a row, by their first word, from the words' hashes; all even."""
    out, last = [], None
    for n in range(WORDS):
        last = mix(words ^ np.uint64(n + 1)) if last is None else mix(last[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n:])
        out.append(last & np.uint64((1 << 64) - 2))
        if len(last) < 2:
            break
    return out


WORD = re.compile(r"[^ ]+")


def around(clean: str, start: int, end: int) -> tuple[int, int]:
    """Where the part begins that has ``WORDS`` words more on either side of what stands from start to end."""
    low = clean.rfind(" ", 0, start) + 1
    for _ in range(WORDS):
        while low and clean[low - 1] == " ":
            low -= 1
        low = clean.rfind(" ", 0, low) + 1
    for _ in range(WORDS + 1):
        m = WORD.search(clean, end)
        end = m.end() if m else len(clean)
    return low, end


def place_patterns(clean: str, places: list[tuple[int, int, bool]], until: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patterns, valid, elsewhere) of places near each other, a row for each: the words before it (even numbers) and behind it (odd ones).

    ``elsewhere`` is at how many other places before ``until`` a pattern's words occur, told once.
    """
    low, high = around(clean, places[0][0], max(until, max(p[1] for p in places)))
    part = clean[low:high]
    starts = np.fromiter((m.start() for m in WORD.finditer(part)), np.int64)
    rows = [r.view(np.int64) for r in sequences(next(iter(text_words([part.encode("utf-8", "surrogatepass")]))))]
    begin, end = (np.fromiter((p[i] - low for p in places), np.int64, len(places)) for i in (0, 1))
    first, behind = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end - 1, "right")
    found, valid = np.zeros((len(places), 2 * WORDS), np.int64), np.zeros((len(places), 2 * WORDS), bool)
    for n, r in enumerate(rows, 1):
        for column, at, odd in ((n - 1, first - n, 0), (WORDS + n - 1, behind, 1)):
            ok = (at >= 0) & (at + n <= len(starts))
            found[ok, column] = r[at[ok]] | odd
            valid[:, column] = ok
    asked, where, here = np.unique(found[valid], return_index=True, return_counts=True)
    own = slice(*np.searchsorted(starts, (places[0][0] - low, until - low)))
    values, n = np.unique(np.concatenate([r[own] for r in rows]), return_counts=True)
    at = np.searchsorted(values, asked & -2).clip(0, max(0, len(values) - 1))
    total = np.where(values[at] == (asked & -2), n[at], 0) if len(values) else np.zeros(len(asked), np.int64)
    told = np.zeros(int(valid.sum()), np.int64)
    told[where] = np.maximum(total - here, 0)
    elsewhere = np.zeros_like(found)
    elsewhere[valid] = told
    return found, valid, elsewhere


def place_groups(clean: str, base: list[Span]) -> Iterator[tuple[list[tuple[int, int, bool]], int]]:
    """(places near each other, where the next ones begin): seeds and candidates by their start."""
    seeds = ((s, e, True) for s, _, e, _ in base)
    group: list[tuple[int, int, bool]] = []
    for place in heapq.merge(seeds, ((s, e, False) for s, e in candidates(clean, base))):
        if group and (place[0] >= group[0][0] + SLICE or len(group) == PLACES):
            yield group, min(place[0], group[0][0] + SLICE)
            group = []
        group.append(place)
    if group:
        yield group, min(len(clean), group[0][0] + SLICE)


DOCS = ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base")
ROWS = pa.schema([
    ("row_id", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", pa.list_(SPAN_TYPE)),
    ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()), ("form", pa.int64()), ("patterns", pa.list_(pa.int64())), ("elsewhere", pa.list_(pa.int64())),
])
ROWS_SQL = (
    f"row_id long, doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, base array<{SPAN_SQL}>, "
    "start long, end long, seed boolean, instance long, form long, patterns array<long>, elsewhere array<long>"
)


def _rows(n: int, **columns: Iterable | pa.Array) -> pa.RecordBatch:
    """A batch of ``ROWS`` with these columns, nulls in the others."""
    arrays = [columns.get(f.name, pa.nulls(n, f.type)) for f in ROWS]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, ROWS, strict=True)], schema=ROWS)


def _lists(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(valid) + 1, np.int32)
    np.cumsum(valid.sum(1), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[valid]))


def _span_lists(spans: list[list[Span]]) -> pa.Array:
    offsets = np.zeros(len(spans) + 1, np.int32)
    np.cumsum([len(x) for x in spans], out=offsets[1:])
    columns = [pa.array((s[i] for own in spans for s in own), f.type) for i, f in enumerate(SPAN_TYPE)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(SPAN_TYPE)))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with its base spans, and one for each place of a seed or candidate with its patterns.

    Rows of places have no base_sha256.  They leave a task in batches of at most ``PLACES``, so what it holds of a text
    are its base spans and one slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            base: list[list[Span]] = [[]] * b.num_rows
            likely = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(b.column("text"), "[0-9@]"), False)).to_pylist()
            for i in likely:
                text = b.column("text")[i].as_py()
                base[i], clean = sorted(base_spans(text)), text.translate(SPACES)
                for places, until in place_groups(clean, base[i]):
                    found, valid, elsewhere = place_patterns(clean, places, until)
                    tokens, n = [text[s:e] for s, e, _ in places], len(places)
                    start, end, seed = zip(*places, strict=True)
                    yield _rows(n, row_id=[row_id + i] * n, start=start, end=end, seed=seed, instance=map(hashed, tokens), form=[hashed(form(t)) for t in tokens], patterns=_lists(found, valid), elsewhere=_lists(elsewhere, valid))
            counts = {f"n_{k}": [sum(s[3] == k for s in own) for own in base] for k in KINDS}
            yield _rows(b.num_rows, row_id=range(row_id, row_id + b.num_rows), doc_id=b.column("doc_id"), **counts, base_sha256=list(map(sha256, base)), base=_span_lists(base))
            row_id += b.num_rows

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ROWS_SQL)


def sequence_map(wanted: DataFrame) -> np.ndarray:
    """A bit for the highest bits of each sequence in ``wanted``: of fixed size, however many there are."""
    place = F.shiftrightunsigned("sequence", 64 - MAP_BITS) + 1  # buckets begin with 1
    parts = wanted.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for bucket, bits in parts.collect():  # at most 2 ** MAP_BITS / 32,768 rows of 4 kB
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def count_sequences(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence, total): how often each word sequence in ``wanted`` occurs in all texts; one scan."""
    bits = sequence_map(wanted)

    def seen(values: np.ndarray) -> np.ndarray:
        at = values >> np.uint64(64 - MAP_BITS)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task sums up what it sees, of up to HELD sequences at once
        parts, held = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
        for b in slices(batches):
            for words in text_words(utf8(b.column("text"))):
                for row in sequences(words) if len(words) else ():
                    found = np.unique(row[seen(row)], return_counts=True)
                    parts.append(found)
                    held += len(found[0])
            if held > HELD:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["sequence", "n"])
                    parts, held = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
        values, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["sequence", "n"])

    hits = id_and_text(docs, id_col, text_col).select("text").mapInArrow(run, "sequence long, n long")
    # summed up before they are joined: a row for each sequence, however many tasks saw it
    return hits.groupBy("sequence").agg(F.sum("n").alias("total")).join(bounded(wanted), "sequence")


def accepted_instances(graph: DataFrame, forms: DataFrame, count, rounds: int, min_support: float, min_confidence: float, min_score: float) -> DataFrame:
    """(instance, score) of unknown instances that the graph (pattern, instance, form, n, seed, elsewhere) makes sure of.

    Every round scores patterns by their instances, and instances by their patterns.  A pattern's support is the sum
    of its instances' scores; against it count its unknown instances, a little, and all places where its words
    stand beside an ordinary word, which ``count`` finds for the patterns that those in the same texts (elsewhere)
    leave sure, so that it isn't asked for common words.  An instance's score is the noisy-or over its sure patterns.
    It is accepted if that is ``min_score`` after being weighed with its form: of the unknown instances of a form (``forms``
    has their number) those without a sure pattern count against it, a little each.  Accepted instances are known in the next round, in which they induce patterns
    of their own; the rounds end when nothing is accepted any more.
    """
    spark = graph.sparkSession
    accepted = spark.createDataFrame([], "instance long, score double")
    counted = spark.createDataFrame([], "sequence long, total long")
    known, sequence = 0, (F.col("pattern").bitwiseAND(F.lit(-2))).alias("sequence")
    share = lambda against: F.col("support") / (F.col("support") + UNKNOWN * F.col("unknown") + against)
    for _ in range(rounds):
        scored = graph.join(accepted, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        stats = scored.groupBy("pattern").agg(F.sum("score").alias("support"), F.count_if(F.col("score") == 0).alias("unknown"), F.count_if(~F.col("seed")).alias("others"), F.sum("n").alias("met"), F.sum("elsewhere").alias("elsewhere"))
        hopeful = stats.where((F.col("others") > 0) & (F.col("support") >= min_support) & (share(F.col("elsewhere")) >= min_confidence)).select("*", sequence)
        hopeful = materialize(hopeful, "hopeful-patterns")
        new = materialize(hopeful.select("sequence").distinct().join(counted, "sequence", "left_anti"), "sequences")
        if not new.isEmpty():
            counted = materialize(counted.unionByName(count(new)), "counted")
        sure = hopeful.join(counted, "sequence").withColumn("confidence", share(F.greatest(F.col("total") - F.col("met"), F.lit(0))))
        sure = materialize(sure.where(F.col("confidence") >= min_confidence).select("pattern", "confidence"), "sure-patterns")
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
        met = materialize(graph.where("not seed").join(sure, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("score"), F.any_value("form").alias("form")), "met-instances")
        weights = met.groupBy("form").agg(F.count("*").alias("in")).join(forms, "form").select("form", (F.col("in") / (F.col("in") + UNKNOWN * (F.col("total") - F.col("in")))).alias("weight"))
        weights = materialize(weights, "form-weights")
        found = met.join(bounded(weights), "form").where(F.col("score") * F.col("weight") >= min_score).select("instance", "score")
        before, accepted = accepted, materialize(accepted.unionByName(found).groupBy("instance").agg(F.max("score").alias("score")), "accepted")
        release(before, hopeful, new, sure, met, weights)
        known, was = accepted.count(), known
        if known == was:
            break
    return accepted


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 5, min_support: float = 0.9, min_confidence: float = 0.7, min_score: float = 0.6
) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans as text and found as an array.

    A null text is empty; repeated rows give repeated results; an empty table gives none.  Base spans of
    different kinds may overlap, spans of kind ``context`` overlap none of them.  Whole texts are read, with tokens
    and words of any length; of a very long one a task holds the text, its base spans, and one slice of what else it finds.
    Candidates have a digit and at least ``TOKEN_CHARS`` code points, and no form of a time, date, amount, version or measure.
    """
    table = materialize(extract(docs, id_col, text_col), "pii")
    rows, places = table.where("base_sha256 is not null").select("row_id", *DOCS), table.where("base_sha256 is null")
    edges = places.select("instance", "seed", "form", F.explode(F.arrays_zip("patterns", "elsewhere")).alias("p")).select("instance", "seed", "form", F.col("p.patterns").alias("pattern"), F.col("p.elsewhere").alias("elsewhere"))
    # aggregates are written before they are joined, so that Spark can split a hot pattern
    graph = materialize(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.any_value("form").alias("form"), F.count("*").alias("n"), F.sum("elsewhere").alias("elsewhere")), "pii-graph")
    forms = materialize(places.where("not seed").select("instance", "form").distinct().groupBy("form").agg(F.count("*").alias("total")), "forms")
    accepted = accepted_instances(graph, forms, lambda wanted: count_sequences(docs, wanted, id_col, text_col), rounds, min_support, min_confidence, min_score)
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(CONTEXT).alias("kind")).cast(SPAN_SQL)
    added = places.where("not seed").join(accepted.select("instance"), "instance", "left_semi").groupBy("row_id").agg(F.collect_list(span).alias("_added"))
    found = F.array_sort(F.concat("base", F.coalesce("_added", F.array().cast(f"array<{SPAN_SQL}>"))))
    out = rows.join(added, "row_id", "left").withColumn("found", found)
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", joined_column(F.col("found")).alias("spans"), "found")
