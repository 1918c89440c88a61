"""Keyword-stuffed pages and lists of links or tags, by perplexity of function words and word classes.

Every text becomes a sequence of stretches: what stands between two function words, described by its length and by the most
marked class of its words (plain, capital, number, identifier, tag, link and so on). A trigram model of stretches is trained
on the prose of the corpus. Its number of symbols is fixed, so its size does not depend on the corpus. Segments of a page
(lines, or sentences of long lines) are abnormal if prose does not predict them (their perplexity under the prose model is
high) or if the page itself predicts them too well (the perplexity of their content words under the page's own word pairs,
each left out of its own prediction, is low). Both limits are set by the perplexities of the corpus's prose. A page is spam
if abnormal segments hold most of its characters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import checkpointed

# Function words of English, German, French and Spanish.
FUNCTION_WORDS = """
a about after all almost an and any anyone are as at be because been before both but by can could do does during each
every few first for from had has have he her his how i if in instead into is it its less many may me more most must my
near never no nobody not of off on once one only or other our out over own she should since so some soon than that the
their them then there these they this those three through to too twice two under unless until up us was we were what when
whenever where which while who whoever why will with without would yet you your
aber ab als am an auch auf aus bei beim beide bis da das dass dem den denn der des die dies diese diesem diesen dieser doch
durch ein eine einem einen einer eines er es für gibt hat haben ich ihr im in ist jede jedem jeden jeder jedes kann kein
keine laut man mehr mit nach nicht noch nur ob oder ohne seit sein seine sich sie sind so sonst statt um und uns unser
unsere von vor war wenn werden weil wer wie wir wird zu zum zur zwei zwischen über
au aux avec avant après car ce ces cet cette chaque comme dans de depuis des dont du dès elle elles en entre est et eux il
ils je la le les leur leurs lorsque mais même moins ne ni nos notre nous on ont ou où par parce pas plus pour presque qu
quand que qui sa sans se selon ses si sinon son sont sous sur surtout tout toute toutes tous trop très tu un une vers votre
vous à été être
al algo ante antes aunque bajo cada casi como con contra cuando de del desde después donde dos el ella ellas ellos en entre
era eran es esa ese eso esta este esto están está fue ha hacia hasta hay la las le lo los más me mi muy más ni nos nuestra
nuestro o para pero por porque pues que quien se según ser si sin sino sobre son su sus también tan todas todo todos tras
tu un una unas uno unos y ya
""".split()

#: Classes that are no function word, in the order of the groups of TOKENS.
FORMS = (
    "url", "span", "identifier", "tag", "price", "CAPITALS", "Capital", "lower", "number", "break", "end", "comma",
    "arrow", "code", "bar", "bullet", "quote", "other", "block",
)
_ID = {w: i for i, w in enumerate(dict.fromkeys((*FORMS, *FUNCTION_WORDS)))}
URL, SPAN, IDENTIFIER, TAG, PRICE, CAPITALS, CAPITAL, LOWER, NUMBER, BREAK, END, COMMA, ARROW, CODE, BAR, BULLET, QUOTE, OTHER, BLOCK = range(19)
CLASSES = len(_ID)

_TOKENS = re.compile(
    r"""(?:https?://|www\.)[^\s)\]>,|"']+|`[^`\n]+`|\n|[.!?…。]+(?=\s|$)|[,;:]|->|=>|[#@][^\W\d]\w*"""
    r"""|[$€£]\s?\d[\d.,]*|\d[\d.,]*\s?(?:€|USD|EUR|\$)|[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w(])|\w+(?:\(\))?|[^\w\s]"""
)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LINK = re.compile(r"""<a\s[^<>]*?href\s*=\s*["']?([^"'\s<>]+)[^<>]*>""", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")

#: Lines of more tokens are cut after sentences; sentences of more than twice as many tokens are cut into parts of so many.
SEGMENT = 24
#: Characters of texts whose tokens are held at once.
CHUNK = 4_000_000
#: A segment whose mean bits a stretch are so many standard deviations above prose's mean is abnormal, and one whose mean
#: bits a content word, under the page's own pairs, are so many below that of prose.
HIGH, LOW = 6.0, 2.9
#: Bits of one stretch at most: a single odd mark in a sentence makes no list.
MOST_BITS = 10.0
#: The page's own model: weight of single words beside pairs, of unseen words beside seen ones, and how many unseen words it supposes.
PAIR_WEIGHT, NEW_WEIGHT, NEW_WORDS = 4.0, 0.05, 20.0
#: Share of a page's characters in abnormal segments from which it is spam, and the tokens they must have at least.
MOST, LEAST_TOKENS = 0.5, 10
#: Share of identifiers, arrows and code marks from which a segment is code or a call listing, which is never abnormal.
CODE_SHARE = 0.4


def classify(token: str) -> int:
    """Class of a token: a function word's own, else by form."""
    c = token[0]
    if c.isalpha():
        known = _ID.get(token.lower())
        if known is not None and known >= len(FORMS):
            return known
        if token[:4] == "http" and "://" in token or token[:4] == "www.":
            return URL
        if not token.replace("-", "").replace("'", "").replace("’", "").isalpha():
            return IDENTIFIER
        if token.isupper() and len(token) > 1:
            return CAPITALS
        if c.isupper():
            return CAPITAL
        return IDENTIFIER if not token.islower() and not token[1:].islower() and token.lower() != token else LOWER
    if c == "\n":
        return BREAK
    if c == "`":
        return SPAN
    if c.isdigit():
        return PRICE if token[-1] in "€$DR" else NUMBER
    if c in ".!?…。":
        return END
    if c in ",;:":
        return COMMA
    if c in "#@" and len(token) > 1:
        return TAG
    if c in "$€£" and len(token) > 1:
        return PRICE
    if token in ("->", "=>"):
        return ARROW
    if c in "{}=+<>&^%~\\":
        return CODE
    if c in "|•»·/":
        return BAR
    if c in "*-–—":
        return BULLET
    if c in "\"'“”„«»‘’[]()":
        return QUOTE
    return IDENTIFIER if c == "_" else OTHER


class _Classes(dict):
    """Codes of the tokens seen so far: class, and a hash of the token in lower case. Emptied when large, so that it holds no
    vocabulary of the corpus."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        code = classify(token) | zlib.crc32(token.lower().encode()) << 16
        self[token] = code
        return code


_CODE = np.zeros(CLASSES, bool)
_CODE[[IDENTIFIER, ARROW, CODE, SPAN]] = True
_CONTENT = np.zeros(CLASSES, bool)
_CONTENT[[LOWER, CAPITAL, CAPITALS, TAG]] = True
#: How marked a class is within a stretch; function words and breaks are 0.
_MARKED = np.zeros(CLASSES, np.int64)
for _rank, _forms in enumerate(((LOWER, END), (CAPITAL, CAPITALS), (COMMA,), (NUMBER, QUOTE), (OTHER, BULLET, BLOCK), (BAR,), (IDENTIFIER, SPAN, ARROW, CODE), (PRICE, TAG), (URL,)), 1):
    _MARKED[list(_forms)] = _rank
RANKS = 9
#: Least lengths of stretches of one bucket: 1, 2, 3, 4, 5, 6, 8, 11, 20 words.
_LENGTHS = np.array([1, 2, 3, 4, 5, 6, 8, 11, 20])
#: Symbols of stretches: none between two function words, or a length and a mark; another set for those that end a segment.
STRETCHES = 1 + len(_LENGTHS) * RANKS
SYMBOLS = 2 * STRETCHES + 1
_EDGE = SYMBOLS - 1
#: What a segment is: a sentence, code, the first of its page.
_IS_PROSE, _IS_CODE = 1, 2


def _plain_text(text: str) -> tuple[str, int]:
    """A text without fenced code and with the links of its markup, and the characters of the code."""
    fenced = 0
    if "```" in text:
        bare = _FENCE.sub("\n", text)
        fenced, text = len(text) - len(bare), bare
    if "</" in text:
        text = _MARKUP.sub("\n", _LINK.sub(r"\n \1 ", text))
    return text, fenced


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each value of ``keys`` stands in it."""
    which, _ = pd.factorize(keys)
    return np.bincount(which)[which] if len(keys) else which


def _cut(lines: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Segment begins: of lines, of the sentences of long lines, of the parts of long sentences."""
    n = len(ids)
    starts = np.flatnonzero(lines)
    lengths = np.diff(np.append(starts, n))
    begins = lines.copy()
    begins[1:] |= np.repeat(lengths > SEGMENT, lengths)[1:] & (ids[:-1] == END) & (ids[1:] != BREAK)
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, n))
    whole = np.repeat(lengths, lengths)
    since = np.arange(n) - np.repeat(starts, lengths)
    return begins | (whole > 2 * SEGMENT) & (since % SEGMENT == 0) & (whole - since >= SEGMENT // 2)


def _own_bits(content: np.ndarray, words: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Bits of each content word under the other words and pairs of its page."""
    keys = page.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ words.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    near = np.zeros(len(keys), bool)
    near[1:] = (page[1:] == page[:-1]) & (np.diff(content) <= 3)
    pairs = keys.copy()
    pairs[1:] = np.where(near[1:], keys[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ keys[1:], keys[1:] * np.uint64(7) + np.uint64(13))
    single, double = _times(keys), _times(pairs)
    before = np.ones(len(keys))
    before[1:] = single[:-1]
    alone = (single - 1 + NEW_WEIGHT) / (_times(page) + NEW_WORDS)
    p = np.where(near, (double - 1 + PAIR_WEIGHT * alone) / (before - 1 + PAIR_WEIGHT), alone)
    return -np.log2(np.minimum(p, 1.0))


def _pages(texts: list[str], classes: _Classes) -> list[tuple]:
    """Of each text: the symbols of its stretches; of each of its segments the number of stretches, characters, tokens, bits
    a content word under the page's own model (NaN with fewer than two), kind; characters of code, number of links."""
    tokens: list[str] = []
    counts, fenced = np.zeros(len(texts), np.int64), []
    for k, text in enumerate(texts):
        bare, code = _plain_text(text)
        found = _TOKENS.findall(bare)
        tokens += found
        counts[k] = len(found)
        fenced.append(code)
    n = len(tokens)
    if not n:
        return [(b"", b"", b"", b"", b"", b"", code, 0) for code in fenced]
    codes = np.fromiter(map(classes.__getitem__, tokens), np.int64, n)
    sizes = np.fromiter(map(len, tokens), np.int64, n)
    ids, page = codes & 0xFFFF, np.repeat(np.arange(len(texts)), counts)
    lines = np.ones(n, bool)
    lines[1:] = (page[1:] != page[:-1]) | (ids[:-1] == BREAK)
    starts = np.flatnonzero(_cut(lines, ids))
    lengths = np.diff(np.append(starts, n))
    segment = np.repeat(np.arange(len(starts)), lengths)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(segment, values, len(starts))

    word, body = ids >= len(FORMS), ids != BREAK
    size, words = total(body), total(word)
    last = np.append(starts[1:], n) - 1
    last = np.where((ids[last] == BREAK) & (lengths > 1), last - 1, last)
    held = np.bincount(np.unique((segment * CLASSES + ids)[word]) // CLASSES, minlength=len(starts))
    prose = (size >= 6) & (ids[last] == END) & (words >= 0.2 * size) & (held >= 3)
    kinds = prose * _IS_PROSE + (total(_CODE[ids]) >= CODE_SHARE * np.maximum(size, 1)) * _IS_CODE
    # Stretches end with a function word or with their segment.
    ends = word.copy()
    ends[np.append(starts[1:], n) - 1] = True
    at = np.flatnonzero(ends)
    first = np.concatenate(([0], at[:-1] + 1))
    final = ~word[at]
    length = at - first + final
    mark = np.maximum(np.maximum.reduceat(_MARKED[ids], first), 1)
    symbol = np.where(length > 0, 1 + (np.searchsorted(_LENGTHS, length, "right") - 1) * RANKS + mark - 1, 0) + STRETCHES * final
    content = np.flatnonzero(_CONTENT[ids])
    own = _own_bits(content, codes[content] >> 16, page[content])
    have = np.bincount(segment[content], minlength=len(starts))
    bits = np.where(have >= 2, np.bincount(segment[content], own, len(starts)) / np.maximum(have, 1), np.nan)
    stretches = np.bincount(segment[at], minlength=len(starts))
    links = np.bincount(page, ids == URL, len(texts)).astype(int).tolist()
    chars = total(sizes * body)
    of_page = np.searchsorted(page[starts], np.arange(len(texts) + 1)).tolist()
    of_symbol = np.searchsorted(page[at], np.arange(len(texts) + 1)).tolist()
    columns = [(symbol.astype(np.uint8 if SYMBOLS < 256 else np.uint16).tobytes(), of_symbol, 1)]
    columns += [(x.tobytes(), of_page, x.itemsize) for x in (stretches.astype(np.int32), chars.astype(np.int64), size.astype(np.int32), bits.astype(np.float32), kinds.astype(np.uint8))]
    return [
        (*(raw[w * bounds[k] : w * bounds[k + 1]] for raw, bounds, w in columns), fenced[k], links[k]) for k in range(len(texts))
    ]


_COLUMNS = ("symbols", "stretches", "chars", "tokens", "own", "kinds", "fenced", "links")
_SCHEMA = "id string, symbols binary, stretches binary, chars binary, tokens binary, own binary, kinds binary, fenced bigint, links bigint"


def _classified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    classes = _Classes()
    for batch in batches:
        texts, begin = batch["text"].tolist(), 0
        while begin < len(texts):
            end, room = begin + 1, CHUNK - len(texts[begin])
            while end < len(texts) and len(texts[end]) <= room:
                room -= len(texts[end])
                end += 1
            frame = pd.DataFrame(_pages(texts[begin:end], classes), columns=list(_COLUMNS))
            frame.insert(0, "id", batch["id"].iloc[begin:end].to_numpy())
            yield frame
            begin = end


class _Segments:
    """The segments of many pages as flat arrays, and the trigram that each of their stretches ends."""

    def __init__(self, batch: pd.DataFrame) -> None:
        def flat(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(batch[name]), kind)

        self.stretches = flat("stretches", np.int32).astype(np.int64)
        self.kinds, self.own = flat("kinds", np.uint8), flat("own", np.float32)
        self.page = np.repeat(np.arange(len(batch)), [len(x) for x in batch["kinds"]])
        self.of = np.repeat(np.arange(len(self.stretches)), self.stretches)
        symbols = flat("symbols", np.uint8).astype(np.int64)
        starts = np.cumsum(self.stretches) - self.stretches
        one, two = np.roll(symbols, 1), np.roll(symbols, 2)
        one[starts] = two[starts] = _EDGE
        second = starts[self.stretches > 1] + 1
        two[second] = _EDGE
        self.trigrams = (two * SYMBOLS + one) * SYMBOLS + symbols


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pages = _Segments(batch)
        counts = pd.Series(pages.trigrams[(pages.kinds & _IS_PROSE > 0)[pages.of]]).value_counts()
        yield pd.DataFrame({"trigram": counts.index.to_numpy(np.int64), "n": counts.to_numpy(np.int64)})


class ProseModel:
    """Bits that a trigram's last symbol costs, by interpolated counts (Witten and Bell).

    Only the trigrams seen are held; tables over pairs of symbols serve the others.
    """

    def __init__(self, trigrams: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(trigrams)
        self.seen, counts = trigrams[order], counts[order].astype(float)
        c2 = np.bincount(self.seen % SYMBOLS**2, counts, SYMBOLS**2)
        c1 = np.bincount(self.seen % SYMBOLS, counts, SYMBOLS)
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SYMBOLS)
        pairs = c2.reshape(SYMBOLS, SYMBOLS)
        n, kinds = pairs.sum(1, keepdims=True), (pairs > 0).sum(1, keepdims=True)
        self.p2 = np.where(n > 0, (pairs + kinds * p1) / np.maximum(n + kinds, 1), p1).ravel()
        n = np.bincount(self.seen // SYMBOLS, counts, SYMBOLS**2)
        kinds = np.bincount(self.seen // SYMBOLS, minlength=SYMBOLS**2)
        self.rest = np.where(n > 0, kinds / np.maximum(n + kinds, 1), 1.0)
        self.share = counts / np.maximum(n + kinds, 1)[self.seen // SYMBOLS]

    def bits(self, trigrams: np.ndarray) -> np.ndarray:
        p = self.rest[trigrams // SYMBOLS] * self.p2[trigrams % SYMBOLS**2]
        if len(self.seen):
            at = np.minimum(np.searchsorted(self.seen, trigrams), len(self.seen) - 1)
            p = p + np.where(self.seen[at] == trigrams, self.share[at], 0.0)
        return np.minimum(-np.log2(p), MOST_BITS)

    def means(self, pages: _Segments) -> tuple[np.ndarray, np.ndarray]:
        """Bits of all stretches, and their mean in each segment."""
        bits = self.bits(pages.trigrams)
        return bits, np.bincount(pages.of, bits, len(pages.stretches)) / np.maximum(pages.stretches, 1)


_MOMENTS = ("n", "total", "squares", "own_n", "own_total", "own_squares")


def _moments(model):
    """Numbers, sums and squares of prose's bits, under the prose model and under the pages' own."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prose = ProseModel(*model.value)
        for batch in batches:
            pages = _Segments(batch)
            sentence = pages.kinds & _IS_PROSE > 0
            mean, own = prose.means(pages)[1][sentence], pages.own[sentence & ~np.isnan(pages.own)].astype(float)
            row = (len(mean), mean.sum(), (mean * mean).sum(), len(own), own.sum(), (own * own).sum())
            yield pd.DataFrame([tuple(map(float, row))], columns=list(_MOMENTS))

    return measure


def _limit(n: float, total: float, squares: float, deviations: float) -> float:
    """So many standard deviations off the mean; beyond everything if nothing was seen."""
    if not n:
        return float("inf") if deviations > 0 else float("-inf")
    mean = total / n
    return mean + deviations * max(0.0, squares / n - mean * mean) ** 0.5


def _scored(model, high: float, low: float):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prose = ProseModel(*model.value)
        for batch in batches:
            pages, n = _Segments(batch), len(batch)
            bits, mean = prose.means(pages)
            with np.errstate(invalid="ignore"):
                abnormal = ((mean > high) | (pages.own < low)) & (pages.kinds & _IS_CODE == 0)
            chars = np.frombuffer(b"".join(batch["chars"]), np.int64)
            tokens = np.frombuffer(b"".join(batch["tokens"]), np.int32)
            whole = np.bincount(pages.page, chars, n) + batch["fenced"].to_numpy(float)
            share = np.bincount(pages.page, chars * abnormal, n) / np.maximum(whole, 1)
            enough = (np.bincount(pages.page, tokens * abnormal, n) >= LEAST_TOKENS) | (batch["links"].to_numpy() >= 4)
            count = np.bincount(pages.page[pages.of], minlength=n)
            mean_bits = np.bincount(pages.page[pages.of], bits, n) / np.maximum(count, 1)
            perplexity = pd.Series(np.where(count > 0, 2.0**mean_bits, np.nan)).astype(object).where(count > 0, None)
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "perplexity": perplexity, "share": share, "spam": (share > MOST) & enough})

    return score


def score_pages(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, perplexity, share, spam)`` of every row: the text's perplexity under the prose model, the share of its
    characters in abnormal segments, and whether it is spam.

    Null, empty and blank texts have no perplexity, share 0 and are no spam. Rows stand for themselves, also if their text
    or id repeats or their id is null. If the corpus holds no sentence, nothing is abnormal. Other columns are ignored. What comes to the driver
    is the model: one number for each trigram of symbols seen, at most SYMBOLS ** 3 (4.5 million, 72 MB) whatever the corpus.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_column).cast("bigint").cast("string").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    pages = checkpointed(texts.mapInPandas(_classified, _SCHEMA))
    slim = pages.select("symbols", "stretches", "own", "kinds")
    counts = slim.mapInPandas(_counted, "trigram bigint, n bigint").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    model = spark.sparkContext.broadcast((counts["trigram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)))
    moments = slim.mapInPandas(_moments(model), ", ".join(f"{m} double" for m in _MOMENTS)).agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in _MOMENTS]).first()
    high, low = _limit(*moments[:3], HIGH), _limit(*moments[3:], -LOW)
    scored = pages.mapInPandas(_scored(model, high, low), "id string, perplexity double, share double, spam boolean")
    return scored.select(F.col("id").cast("bigint").alias(id_column), "perplexity", "share", "spam")
