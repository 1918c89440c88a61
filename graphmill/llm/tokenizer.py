"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by Spark higher-order functions.

Texts are cut into words by the vocabulary's pattern on the JVM. Every distinct word is encoded once: its bytes are folded
by ranked merges against a literal rank map. Frequent words come back to the texts by a broadcast of fixed size, the others
by a join.

The literal map has two levels, an array of small maps that the CRC of the key selects from, because a lookup in a Spark
map scans it. Byte strings are written in hexadecimal, where concatenation of bytes is concatenation of strings.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.session import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts text into words before the merges of the public rank file.
# ``\s`` is written out for Java below.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: the white space of Unicode, as a Java character class without its brackets.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_JAVA_PATTERN = (
    PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
)

#: Small maps in a literal map; about 12 entries each for 50,000 tokens.
BUCKETS = 4096
#: Words up to so many bytes are folded by expressions, longer ones by a heap, as the fold's work is quadratic.
FOLD_BYTES = 96


@lru_cache(maxsize=4)
def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The rank file as ``bytes -> id``; raises if it lacks one of the 256 single bytes."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{path} is no complete byte-level vocabulary")
    return ranks


def _literal(entries: dict[str, int]) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return json.dumps(buckets, ensure_ascii=False)


@lru_cache(maxsize=4)
def _literals(path: str) -> str:
    """JSON of the rank map, keyed by the bytes in hexadecimal."""
    return _literal({token.hex().upper(): rank for token, rank in read_ranks(path).items()})


def _map(json_text: str) -> Column:
    return F.from_json(F.lit(json_text), "array<map<string,int>>")


def _looked_up(maps: Column, key: Column) -> Column:
    bucket = F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")
    return F.try_element_at(F.get(maps, bucket), key)


def words_of(text: Column) -> Column:
    """The words of a text, in order; together they are the text. Null gives null."""
    return F.regexp_extract_all(text, F.lit(_JAVA_PATTERN), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of a word by ranked merges over its bytes: the adjacent pair of the least rank is joined until none has a rank."""

    def rank(pair: Column) -> Column:
        return _looked_up(ranks, pair)

    def pair_ranks(pieces: Column) -> Column:
        return F.when(
            F.size(pieces) > 1,
            F.transform(
                F.sequence(F.lit(0), F.size(pieces) - 2),
                lambda i: rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))),
            ),
        ).otherwise(F.array().cast("array<int>"))

    def merged(state: Column) -> Column:
        pieces, pairs = state["pieces"], state["pairs"]

        def at(k: Column) -> Column:  # k: 1-based place of the pair with the least rank
            both = F.concat(F.get(pieces, k - 1), F.get(pieces, k))
            left = F.when(k > 1, F.array(rank(F.concat(F.get(pieces, k - 2), both))))
            right = F.when(k + 1 < F.size(pieces), F.array(rank(F.concat(both, F.get(pieces, k + 1)))))
            none = F.array().cast("array<int>")
            return F.struct(
                F.concat(
                    F.slice(pieces, F.lit(1), k - 1), F.array(both), F.slice(pieces, k + 2, F.size(pieces))
                ).alias("pieces"),
                F.concat(
                    F.slice(pairs, F.lit(1), F.greatest(k - 2, F.lit(0))),
                    F.coalesce(left, none),
                    F.coalesce(right, none),
                    F.slice(pairs, k + 2, F.size(pairs)),
                ).alias("pairs"),
            )

        least = F.array_min(pairs)
        return F.when(least.isNull(), state).otherwise(
            _let(F.array_position(pairs, least).cast("int"), at)
        )

    split = F.regexp_extract_all(F.hex(word), F.lit(".."), F.lit(0))
    start = _let(split, lambda p: F.struct(p.alias("pieces"), pair_ranks(p).alias("pairs")))
    rounds = F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1)))
    last = F.aggregate(rounds, start, lambda state, _: merged(state))
    return F.transform(last["pieces"], rank)


def _heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs, for words whose bytes are many."""
    pieces: list[bytes | None] = [bytes([b]) for b in word]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def push(i: int) -> None:
        if 0 <= i and after[i] < len(word) and (both := pieces[i] + pieces[after[i]]) in ranks:
            heapq.heappush(heap, (ranks[both], i, both))

    for i in range(len(word) - 1):
        push(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if pieces[i] is None or after[i] >= len(word) or pieces[i] + pieces[after[i]] != both:
            continue
        gone = after[i]
        pieces[i], pieces[gone], after[i] = both, None, after[gone]
        if after[i] < len(word):
            before[after[i]] = i
        push(before[i])
        push(i)
    return [ranks[p] for p in pieces if p is not None]


def _long_words(ranks):
    """Encodes words by a broadcast rank map: workers need no vocabulary file."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=[_heap_merges(w.encode(), ranks.value) for w in batch["word"]])

    return encode


def encode_words(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``words`` with ``ids`` added; ``words`` has distinct non-null words in the column ``word`` and their number in ``n``."""
    short = words.filter(F.octet_length("word") <= FOLD_BYTES).select(
        "word", "n", fold_merges(F.col("word"), _map(_literals(path))).alias("ids")
    )
    ranks = words.sparkSession.sparkContext.broadcast(read_ranks(path))
    long = words.filter(F.octet_length("word") > FOLD_BYTES).mapInPandas(_long_words(ranks), "word string, n bigint, ids array<int>")
    return short.unionByName(long)


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)]


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _assembled(dictionary):
    """Replaces words by ids from a broadcast ``(words, ids)``. What is not known of a text comes out as its distinct
    ``words``, with a mark for each occurrence: ``at`` which id it is missing and ``which`` word it is."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = dictionary.value
        lengths, flat_ids = pc.list_value_length(ids).to_numpy(zero_copy_only=False), ids.flatten().to_numpy()
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        for batch in batches:
            words = batch.column(1)
            bounds = words.offsets.to_numpy().astype(np.int64)
            bounds, flat = bounds - bounds[0], words.flatten()
            at = pc.index_in(flat, value_set=known)
            missing = at.is_null().to_numpy(zero_copy_only=False)
            at = at.fill_null(0).to_numpy()
            sizes = np.where(missing, 0, lengths[at]) if len(known) else np.zeros(len(at), np.int64)
            values = _gathered(flat_ids, starts[at], sizes) if len(known) else np.zeros(0, np.int32)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            row = np.repeat(np.arange(len(batch)), np.diff(bounds))[missing]
            gone = flat.filter(pa.array(missing)).dictionary_encode()
            codes = gone.indices.to_numpy().astype(np.int64)
            kinds = max(len(gone.dictionary), 1)
            distinct, which = np.unique(row * kinds + codes, return_inverse=True)
            per_row = np.searchsorted(distinct // kinds, np.arange(len(batch) + 1))
            marks = np.searchsorted(row, np.arange(len(batch) + 1))
            place = ends[:-1][missing] - ends[bounds[:-1]][row]
            columns = [
                batch.column(0), _lists(ends[bounds], pa.array(values.astype(np.int32))), _lists(per_row, gone.dictionary.take(pa.array(distinct % kinds))),
                _lists(marks, pa.array(place.astype(np.int32))), _lists(marks, pa.array((which - per_row[row]).astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "words", "at", "which"])

    return assemble


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the ids of a text's ``parts``, one list for each of its missing words, where its marks say."""

    def flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        bounds = lists.offsets.to_numpy().astype(np.int64)
        return bounds - bounds[0], lists.flatten()

    for batch in batches:
        row_ids, ids = flat(batch.column("ids"))
        row_marks, at = flat(batch.column("at"))
        which = batch.column("which").flatten().to_numpy()
        row_parts, parts = flat(batch.column("parts"))
        part_bounds, part_ids = flat(parts)
        n, row = len(batch), np.repeat(np.arange(len(batch)), np.diff(row_marks))
        upto = row_ids[:-1][row] + at.to_numpy()
        before = np.concatenate(([0], upto[:-1])) if len(upto) else upto
        before = np.where(np.arange(len(row)) == row_marks[:-1][row], row_ids[:-1][row], before)
        part = row_parts[:-1][row] + which
        # A text's pieces: known ids and a part for each mark, and known ids at the end.
        starts, sizes = np.zeros(2 * len(row) + n, np.int64), np.zeros(2 * len(row) + n, np.int64)
        k = 2 * np.arange(len(row)) + row
        starts[k], sizes[k] = before, upto - before
        starts[k + 1], sizes[k + 1] = len(ids) + part_bounds[:-1][part], np.diff(part_bounds)[part]
        last = 2 * row_marks[1:] + np.arange(n)
        rest = row_ids[:-1].copy()
        some = np.diff(row_marks) > 0
        rest[some] = upto[row_marks[1:][some] - 1]
        starts[last], sizes[last] = rest, row_ids[1:] - rest
        values = _gathered(np.concatenate((ids.to_numpy(), part_ids.to_numpy())), starts, sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], last + 1))]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), _lists(ends, pa.array(values.astype(np.int32)))], ["_id", "ids"])


def encode(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY, frequent: int = 65536,
) -> DataFrame:
    """``(id_column, ids)``: the token ids of each row's text, without special tokens.

    Null and empty texts have the empty list. Strings of special tokens in a text are ordinary text. ``id_column`` must be
    unique and not null. Other columns are ignored, whatever their names. An empty table gives no rows.

    Each distinct word of the corpus is encoded once. The ``frequent`` most frequent words of at most FOLD_BYTES bytes are
    broadcast, which bounds the broadcast whatever the corpus; texts with rarer words get those by a join, each word once a
    text. None of these words has more than one in ``frequent`` of the occurrences, so the join has no hot key.
    """
    texts, encoded, dictionary, complete = _dictionary(documents, id_column, text_column, path, frequent)
    kind = texts.schema["_id"].dataType.simpleString()
    whole = texts.mapInArrow(_assembled(dictionary), f"_id {kind}, ids array<int>, words array<string>, at array<int>, which array<int>")
    if complete:
        return whole.select(F.col("_id").alias(id_column), "ids")
    whole = checkpointed(whole)
    missing = whole.select("_id", F.posexplode("words").alias("_pos", "word"))
    found = missing.join(encoded.select("word", F.col("ids").alias("part")), "word").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "part"))).alias("_all"))
    holes = whole.filter(F.size("words") > 0).select("_id", "ids", "at", "which").join(found.select("_id", F.col("_all.part").alias("parts")), "_id")
    filled = holes.mapInArrow(_spliced, f"_id {kind}, ids array<int>")
    return whole.filter(F.size("words") == 0).select("_id", "ids").unionByName(filled).withColumnRenamed("_id", id_column)


def _dictionary(documents: DataFrame, id_column: str, text_column: str, path: str, frequent: int):
    """Words of the texts, all distinct words encoded, the broadcast of the frequent ones, and whether those are all."""
    texts = documents.select(F.col(id_column).alias("_id"), words_of(F.coalesce(F.col(text_column), F.lit(""))).alias("_words"))
    counts = checkpointed(texts.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    encoded = checkpointed(encode_words(counts, path))
    top = encoded.filter(F.octet_length("word") <= FOLD_BYTES).orderBy(F.desc("n"), "word").limit(frequent).toArrow().combine_chunks()
    words, ids = (top.column(c).combine_chunks() if top.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("ids", pa.list_(pa.int32()))))
    dictionary = documents.sparkSession.sparkContext.broadcast((words.cast(pa.string()), ids.cast(pa.list_(pa.int32()))))
    return texts, encoded, dictionary, encoded.count() == top.num_rows


def _summed(dictionary):
    """The tokens of the known words of each text, and the words that are not known."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = dictionary.value
        lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        for batch in batches:
            words = batch.column(1)
            bounds = words.offsets.to_numpy().astype(np.int64)
            bounds, flat = bounds - bounds[0], words.flatten()
            at = pc.index_in(flat, value_set=known)
            missing = at.is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(missing, 0, lengths[at.fill_null(0).to_numpy()]) if len(known) else np.zeros(len(at), np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))[bounds]
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(missing)))[bounds].astype(np.int32)), flat.filter(pa.array(missing)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), rest], ["_id", "tokens", "rest"])

    return assemble


def token_counts(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY, frequent: int = 65536
) -> DataFrame:
    """``(id_column, tokens)``: how many tokens each row's text has; 0 for null and empty texts. As ``encode`` otherwise."""
    texts, encoded, dictionary, complete = _dictionary(documents, id_column, text_column, path, frequent)
    kind = texts.schema["_id"].dataType.simpleString()
    summed = texts.mapInArrow(_summed(dictionary), f"_id {kind}, tokens bigint, rest array<string>")
    if complete:
        return summed.select(F.col("_id").alias(id_column), "tokens")
    summed = checkpointed(summed)
    holes = summed.select("_id", F.explode("rest").alias("word"))
    parts = holes.join(encoded.select("word", F.size("ids").cast("bigint").alias("tokens")), "word").select("_id", "tokens")
    return summed.select("_id", "tokens").unionByName(parts).groupBy("_id").agg(F.sum("tokens").alias("tokens")).withColumnRenamed("_id", id_column)


def decode(encoded: DataFrame, id_column: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``(id_column, text)``: the text of each list of ids, by concatenation of the tokens' bytes. Null gives null."""
    by_id = {str(rank): token.hex() for token, rank in read_ranks(path).items()}
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for key, value in by_id.items():
        buckets[int(key) % BUCKETS][key] = value
    maps = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    pieces = F.transform(
        "ids", lambda i: F.try_element_at(F.get(maps, F.pmod(i, F.lit(BUCKETS)).cast("int")), i.cast("string"))
    )
    return encoded.select(id_column, F.decode(F.unhex(F.array_join(pieces, "")), "UTF-8").alias("text"))
