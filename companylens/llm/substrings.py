"""Removal of passages that stand in an earlier document, by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of a document. A word goes if a window that covers it
also stands in a document with a smaller id. Such windows are repeats, and repeats are deep
internal nodes of the suffix tree of all texts. That tree is never built as a whole:

1. Every window has an anchor, its least hashed ``ANCHOR``-gram of words; equal windows have
   equal anchors at equal places. Suffixes are taken at anchors, one for all consecutive
   windows with the same anchor (a run), with the words to the left that its windows reach.
   A suffix that only one document has is no repeat. Equal runs are one leaf, which knows the
   first document that holds it: the runs of all later documents go.
2. Suffixes with the same prefix, at first the anchor, are a group. A group that is larger
   than a task should hold (``GROUP_RUNS``) is split by longer prefixes. A prefix of p words
   from the place s lies in the windows that start from s+p-``window`` to s, so the windows of
   a run are dealt to suffixes at several places, each with its longer prefix. Equal windows
   are dealt alike, so they meet again. In the end the prefix is the window itself; then no
   tree is needed, and the first document of the prefix is a partial minimum.
3. Within a task the suffixes of its groups are sorted, and the lengths of common prefixes of
   neighbours give the nodes of each subtree at every depth; the same is done for the words to
   the left. A window that starts o words before the suffix is repeated exactly if its suffix
   shares the node at depth window-o with another one that has the same o words to the left.

Words are compared by 64-bit hashes within a task, runs and prefixes by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.llm.kernels import blocks, mix, powers, prefix_sums, ragged, span_hashes, text_bytes, word_spans
from companylens.operators.distributed import join_by_key, materialize

WINDOW = 50
ANCHOR = 12
# Suffixes of a group, and about how many suffixes a task sorts at once (whole groups).
GROUP_RUNS = 4_000
SORT_RUNS = 8_000
# Bytes of text whose words are hashed at once.
TEXT_BYTES = 1 << 20
# Order of documents without an id.
BEHIND = (1 << 63) - 1

_STEP = 0xC2B2AE3D27D4EB4F

# ``lows``: first word of each place where the run stands in its document; ``width``: its windows.
RUN_SCHEMA = "prefix long, run long, doc long, row long, lows array<int>, width int, at int"
PIECE_SCHEMA = "prefix long, members long, doc long, row long, lows array<int>, at int, words binary"
SPAN_SCHEMA = "row long, low int, high int"


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, rows and hashes of the words of a block, and each row's first word."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(prefix_sums(data), starts, ends)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    return starts, ends, rows, hashes, first


def _sequence_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any sequence of words follows."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_STEP, len(hashes) + 1)[: len(hashes)], out=sums[1:])
    return sums


_UNSTEP = pow(_STEP, -1, 1 << 64)


def _sequence_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value = (sums[ends] - sums[starts]) * powers(_UNSTEP, len(sums))[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def anchored_runs(
    hashes: np.ndarray, first: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor place, anchor hash and run hash of a block's runs."""
    size = min(ANCHOR, window)
    n = len(hashes)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = _sequence_sums(hashes)
    places = np.arange(n - size + 1)
    grams = _sequence_hashes(sums, places, places + size)
    # The place in the low bits breaks ties to the left, alike in every copy.
    bits = np.uint64(max(24, n.bit_length()))
    keys = (grams >> bits << bits) | places.astype(np.uint64)
    width = window - size + 1
    fill = np.full(-len(keys) % width, ~np.uint64(0))
    table = np.concatenate((keys, fill)).reshape(-1, width)
    from_left = np.minimum.accumulate(table, axis=1).ravel()
    from_right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(from_right[: n - window + 1], from_left[width - 1 : len(keys)])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    end_of = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(anchor)) + window <= end_of[: len(anchor)])
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    low = starts[begin]
    high = starts[np.append(begin[1:], len(starts)) - 1] if len(starts) else low
    return low, high, own[begin], grams[own[begin]], _sequence_hashes(sums, low, high + window)


def _runs_of(texts: DataFrame, window: int) -> DataFrame:
    """RUN_SCHEMA; equal runs of a document are one row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            row = batch.column("row").to_numpy(zero_copy_only=False)
            for begin, end in blocks(offsets, TEXT_BYTES):
                part = data[offsets[begin] : offsets[end]]
                _, _, rows, hashes, first = _word_hashes(part, offsets[begin : end + 1] - offsets[begin])
                low, high, anchor, prefix, run = anchored_runs(hashes, first, window)
                text = rows[low]
                order = np.lexsort((low, run, prefix, text))
                low, high, anchor, prefix, run, text = (
                    x[order] for x in (low, high, anchor, prefix, run, text)
                )
                new = np.ones(len(low), bool)
                new[1:] = (run[1:] != run[:-1]) | (prefix[1:] != prefix[:-1]) | (text[1:] != text[:-1])
                lead = np.flatnonzero(new)
                ends = np.append(lead, len(low)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prefix[lead].view(np.int64)),
                        pa.array(run[lead].view(np.int64)),
                        pa.array(doc[begin + text[lead]]),
                        pa.array(row[begin + text[lead]]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array((low - first[text]).astype(np.int32))),
                        pa.array((high - low + 1)[lead].astype(np.int32)),
                        pa.array((anchor - low)[lead].astype(np.int32)),
                    ],
                    ["prefix", "run", "doc", "row", "lows", "width", "at"],
                )

    return texts.mapInArrow(find, RUN_SCHEMA)


def _pieces(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """PIECE_SCHEMA: the words of the wanted runs (prefix, members, doc, row, lows, width, at)."""
    parts = wanted.groupBy("row").agg(
        F.collect_list(F.struct("prefix", "members", "lows", "width", "at")).alias("parts")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("parts")
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy().astype(np.int64)))
            flat = lists.flatten()
            for begin, end in blocks(offsets, TEXT_BYTES):
                part = data[offsets[begin] : offsets[end]]
                starts, stops, _, _, first = _word_hashes(part, offsets[begin : end + 1] - offsets[begin])
                own = flat.slice(ends[begin], ends[end] - ends[begin])
                owner = np.repeat(np.arange(begin, end), np.diff(ends[begin : end + 1]))
                lows = own.field("lows")
                at_first = lows.flatten().to_numpy()[
                    np.append(0, np.cumsum(lows.value_lengths().to_numpy().astype(np.int64)))[:-1]
                ]
                low = first[owner - begin] + at_first
                last = low + own.field("width").to_numpy().astype(np.int64) + window - 2
                size = stops[last] - starts[low]
                words = part[ragged(starts[low], size)]
                word_ends = np.append(0, np.cumsum(size)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.field("prefix"),
                        own.field("members"),
                        batch.column("doc").take(pa.array(owner)),
                        batch.column("row").take(pa.array(owner)),
                        lows,
                        own.field("at"),
                        pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(word_ends), pa.py_buffer(words)]),
                    ],
                    ["prefix", "members", "doc", "row", "lows", "at", "words"],
                )

    joined = texts.join(parts, "row").select("row", "doc", "text", "parts")
    return joined.mapInArrow(cut, PIECE_SCHEMA)


def _split(pieces: DataFrame, size: int, window: int) -> DataFrame:
    """The windows of the pieces, dealt to suffixes with prefixes of ``size`` words.

    Places are counted from the old suffix, so pieces of a group are dealt alike.
    """
    reach = window - size + 1  # windows of a suffix with such a prefix

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("words"))
            for begin, end in blocks(offsets, TEXT_BYTES):
                part = data[offsets[begin] : offsets[end]]
                rows = batch.slice(begin, end - begin)
                starts, stops, _, hashes, first = _word_hashes(part, offsets[begin : end + 1] - offsets[begin])
                at = rows.column("at").to_numpy().astype(np.int64)
                windows = np.diff(first) - window + 1
                # Window t lies at - t words before the suffix: that is slot (at - t) // reach.
                top = at // reach
                bottom = (at - windows + 1) // reach
                owner = np.repeat(np.arange(len(at)), top - bottom + 1)
                slot = top[owner] - (ragged(np.zeros(len(at), np.int64), top - bottom + 1))
                high = np.minimum(at[owner] - slot * reach, windows[owner] - 1)
                low = np.maximum(at[owner] - slot * reach - reach + 1, 0)
                place = at[owner] - slot * reach  # the new suffix, from the piece's first word
                base = first[owner]
                sums = _sequence_sums(hashes)
                prefix = _sequence_hashes(sums, base + place, base + place + size)
                old = rows.column("prefix").to_numpy(zero_copy_only=False).view(np.uint64)[owner]
                prefix = mix(prefix ^ mix(old + slot.astype(np.uint64) + np.uint64(size << 32)))
                from_byte, to_byte = starts[base + low], stops[base + high + window - 1]
                size_of = to_byte - from_byte
                ends = np.append(0, np.cumsum(size_of)).astype(np.int32)
                lows = rows.column("lows").take(pa.array(owner))
                counts = lows.value_lengths().to_numpy().astype(np.int64)
                moved = lows.flatten().to_numpy() + np.repeat(low, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prefix.view(np.int64)),
                        pa.array(np.zeros(len(owner), np.int64)),
                        rows.column("doc").take(pa.array(owner)),
                        rows.column("row").take(pa.array(owner)),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(moved.astype(np.int32))
                        ),
                        pa.array((place - low).astype(np.int32)),
                        pa.Array.from_buffers(
                            pa.binary(), len(owner), [None, pa.py_buffer(ends), pa.py_buffer(part[ragged(from_byte, size_of)])]
                        ),
                    ],
                    ["prefix", "members", "doc", "row", "lows", "at", "words"],
                )

    return pieces.mapInArrow(deal, PIECE_SCHEMA)


def _nodes(context: np.ndarray, group: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of the contexts by group, and common words with the one before.

    Cutting the order where fewer than d words are common gives the nodes at depth d.
    """
    order = np.lexsort((*[context[:, j] for j in range(deep - 1, -1, -1)], group))
    ordered = context[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(1), differ.argmax(1), deep) if deep else np.zeros(len(order) - 1, np.int64)
    common = np.append(-1, np.where(group[order][1:] == group[order][:-1], common, -1))
    return order, common, np.arange(len(order))


def repeats_of_groups(
    group: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """(member, window) of all windows that stand in an earlier document of their group."""
    _, _, _, hashes, first = _word_hashes(data, offsets)
    n = len(at)
    count = np.diff(first)
    windows = count - window + 1
    farthest = int(at.max(initial=0))
    place = first[:-1] + at
    padded = np.append(hashes, np.uint64(0))

    def context(offset: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, padded[np.where(inside, offset, 0)], 0)

    ahead = place[:, None] + np.arange(window)
    back = place[:, None] - 1 - np.arange(farthest)
    right, right_common, _ = _nodes(context(ahead, ahead < first[1:, None]), group, window)
    left, left_common, _ = _nodes(context(back, back >= first[:-1, None]), group, farthest)
    # Documents in their order; rows decide between rows of one id.
    rank = np.empty(n, np.int64)
    by_doc = np.lexsort((row, doc))
    turn = np.append(True, (doc[by_doc][1:] != doc[by_doc][:-1]) | (row[by_doc][1:] != row[by_doc][:-1]))
    rank[by_doc] = np.cumsum(turn)
    members, starts = [], []
    node_right, node_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(farthest + 1):
        valid = (o <= at) & (at - o < windows)
        if valid.sum() < 2:
            continue
        node_right[right] = np.cumsum(right_common < window - o)
        node_left[left] = np.cumsum(left_common < o)
        who = np.flatnonzero(valid)
        node = node_right[who] * (n + 1) + node_left[who]
        order = np.lexsort((rank[who], node))
        who, node = who[order], node[order]
        lead = np.append(True, node[1:] != node[:-1])
        earliest = rank[who][lead][np.cumsum(lead) - 1]
        late = who[rank[who] > earliest]
        members.append(late)
        starts.append(at[late] - o)
    if not members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(members), np.concatenate(starts)


def _spread(rows: np.ndarray, lows: pa.Array, member: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """SPAN_SCHEMA of windows of members, at every place where the member stands."""
    order = np.lexsort((start, member))
    member, start = member[order], start[order]
    new = np.ones(len(member), bool)
    new[1:] = (member[1:] != member[:-1]) | (start[1:] != start[:-1] + 1)
    lead = np.flatnonzero(new)
    last = start[np.append(lead[1:], len(member)) - 1] if len(lead) else start
    member, low = member[lead], start[lead]
    places = lows.take(pa.array(member))
    counts = places.value_lengths().to_numpy().astype(np.int64)
    base = places.flatten().to_numpy().astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(rows[member], counts), pa.int64()),
            pa.array((base + np.repeat(low, counts)).astype(np.int32)),
            pa.array((base + np.repeat(last, counts)).astype(np.int32)),
        ],
        ["row", "low", "high"],
    )


def _by_subtrees(pieces: DataFrame, window: int) -> DataFrame:
    """SPAN_SCHEMA of the late windows of whole groups, built in tasks."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("words"))
        group, doc, row, at = (
            batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("prefix", "doc", "row", "at")
        )
        member, start = repeats_of_groups(group, doc, row, at, data, offsets, window)
        return _spread(row, batch.column("lows"), member, start)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = batch.column("prefix").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            if kept and kept[-1].column("prefix")[-1].as_py() != prefix[0]:
                turns = np.append(0, turns)
            begin = 0
            for turn in turns:
                if size + turn - begin >= SORT_RUNS:
                    kept.append(batch.slice(begin, turn - begin))
                    yield solve(_joined(kept))
                    kept, size, begin = [], 0, turn
            kept.append(batch.slice(begin))
            size += batch.num_rows - begin
        if kept:
            yield solve(_joined(kept))

    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        pieces.repartition(partitions, "prefix")
        .sortWithinPartitions("prefix")
        .mapInArrow(build, SPAN_SCHEMA)
    )


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _prefix_sizes(window: int) -> list[int]:
    """Ever longer prefixes; the last one is the whole window."""
    return sorted({(min(ANCHOR, window) + window) // 2, window - window // 8, window})


def late_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """SPAN_SCHEMA: ranges of window starts that also stand in an earlier document.

    ``texts`` has a unique ``row``, ``doc`` (its order; rows decide between equal ones) and
    ``text``. Ranges of a row may touch or overlap.
    """
    runs = materialize(_runs_of(texts, window), "word-runs")
    leaf = F.struct("doc", "row", "lows")
    classes = materialize(
        runs.groupBy("prefix", "run").agg(
            F.min(leaf).alias("first"), F.first("width").alias("width"), F.first("at").alias("at")
        ),
        "leaves",
    )
    # A run that isn't the first of its class is late as a whole; no two rows share the key.
    firsts = classes.select("prefix", "run", F.col("first.row").alias("row"))
    late = runs.join(firsts, ["row", "prefix", "run"], "left_anti").select(
        "row", F.explode("lows").alias("low"), "width"
    )
    found = late.select("row", "low", (F.col("low") + F.col("width") - 1).alias("high"))

    groups = (
        classes.groupBy("prefix")
        .agg(
            F.count("*").alias("members"),
            F.min("first.row").alias("one"),
            F.max("first.row").alias("two"),
        )
        .where("members > 1 and one < two")
        .select("prefix", "members", F.col("members").alias("weight"))
    )
    wanted = (
        join_by_key(classes, groups, ["prefix"], "weight", ["run"])
        .where("members is not null")
        .select("prefix", "members", "first.*", "width", "at")
    )
    pieces = materialize(_pieces(texts, wanted, window), "pieces")
    found = found.unionAll(_by_subtrees(pieces.where(F.col("members") <= GROUP_RUNS), window))
    large = pieces.where(F.col("members") > GROUP_RUNS)
    for size in _prefix_sizes(window):
        if not large.limit(1).count():
            break
        dealt = materialize(_split(large, size, window), "longer-prefixes")
        groups = (
            dealt.groupBy("prefix")
            .agg(
                F.count("*").alias("weight"),
                F.min("row").alias("one"),
                F.max("row").alias("two"),
                F.min(F.struct("doc", "row")).alias("first"),
            )
            .where("one < two")
            .select("prefix", "weight", F.col("weight").alias("members"), "first")
        )
        named = join_by_key(dealt.drop("members"), groups, ["prefix"], "weight", ["row", "lows"]).where(
            "members is not null"
        )
        if size == window:  # one window each, and all of a group are equal
            rest = named.where(F.col("row") != F.col("first.row")).select("row", F.explode("lows").alias("low"))
            return found.unionAll(rest.select("row", "low", F.col("low").alias("high")))
        pieces = materialize(named.select(*dealt.columns), "pieces")
        found = found.unionAll(_by_subtrees(pieces.where(F.col("members") <= GROUP_RUNS), window))
        large = pieces.where(F.col("members") > GROUP_RUNS)
    return found


def packed_rows(docs: DataFrame) -> DataFrame:
    """(row, doc, text, original): rows with a unique number, whatever their columns are called.

    ``row`` and ``doc`` are doc_id where it is a key. Otherwise rows are stored with numbers, and
    ``doc`` is doc_id, a null one behind all others.
    """
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc"),
        F.col("text").cast("string").alias("text"),
        F.struct(*[F.col(c) for c in docs.columns]).alias("original"),
    )
    bad = packed.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null")
    if not bad.limit(1).count():
        return packed.withColumn("row", F.col("doc"))
    numbered = packed.withColumn("row", F.monotonically_increasing_id())
    return materialize(numbered.withColumn("doc", F.coalesce("doc", F.lit(BEHIND))), "numbered")


CUT_SCHEMA = "row long, doc long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(texts: DataFrame, spans: DataFrame, window: int, with_text: bool) -> DataFrame:
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_of, rows = batch.column("text"), batch.column("row")
            lists = batch.column("spans").fill_null([])
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy().astype(np.int64)))
            low = lists.flatten().field("low").to_numpy().astype(np.int64)
            high = lists.flatten().field("high").to_numpy().astype(np.int64) + window
            for begin, end in blocks(text_bytes(texts_of)[1], TEXT_BYTES):
                out: list[tuple] = []
                for i in range(begin, end):
                    text = texts_of[i].as_py()
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    kept = words
                    if ends[i] < ends[i + 1]:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, low[ends[i] : ends[i + 1]], 1)
                        np.add.at(change, high[ends[i] : ends[i + 1]], -1)
                        gone = np.cumsum(change[:-1]) > 0
                        kept = [words[j] for j in np.flatnonzero(~gone)]
                    rest = b" ".join(kept)
                    plain = None
                    if with_text and text is not None:
                        plain = text if kept is words else rest.decode("utf-8", "surrogatepass")
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), plain))
                n_words, n_removed, digest, plain = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.slice(begin, end - begin),
                        batch.column("doc").slice(begin, end - begin),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_removed, pa.int64()),
                        pa.array(digest, pa.string()),
                        pa.array(plain, pa.string()),
                    ],
                    ["row", "doc", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    joined = texts.join(per_row, "row", "left").select("row", "doc", "text", "spans")
    return joined.mapInArrow(cut, CUT_SCHEMA)


def remove_earlier_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept_text of every row.

    A word goes if a window of ``window`` words that covers it also stands in a document with
    a smaller doc_id; windows are judged on the input. kept_text is the text as it was if
    nothing goes, else the kept words with one space between them; kept_sha256 always is over
    the latter. A null text has no words and a null kept_text. Of rows with one doc_id the
    first stored is the earlier one; a null doc_id comes after all others. Columns of
    ``docs`` with the added names are replaced. An empty table stays empty.
    """
    added = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    packed = packed_rows(docs.drop(*added))
    texts = packed.select("row", "doc", "text")
    results = _cut(texts, late_windows(texts, window), window, with_text=True).drop("doc")
    return packed.select("row", "original").join(results, "row").select("original.*", *added)


def op11_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = packed_rows(docs).select("row", "doc", "text")
    results = _cut(texts, late_windows(texts), WINDOW, with_text=False)
    doc_id = F.nullif("doc", F.lit(BEHIND)).alias("doc_id")
    return results.select(doc_id, "n_words", "n_removed", "kept_sha256")
