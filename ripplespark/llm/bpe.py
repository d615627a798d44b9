"""BPE encoding and decoding with a public vocabulary, by batched merge rounds in numpy.

The tokenizer file gives a vocabulary, ranked merges and two special strings.  A text is
cut at the special strings, each piece is brought into NFC and lower case and split into
words; every distinct word of a batch becomes a run of symbols in one flat array.  In each
round the ranks of all adjacent pairs are found by binary search over the sorted pair
keys, every word merges its leftmost pair of lowest rank, and words without a pair to
merge leave.  Words of more than ``LONG_WORD`` bytes take rounds by rank instead: a round
merges every place of the lowest pair left and ranks only the pairs beside those places,
so that an unbroken text of megabytes takes time in proportion to its length.  Encoded
words are kept in a cache of bounded size.

Null texts count as empty, which give no ids.  Texts are encoded whole, however long.  Null
and repeated ids stay, each row on its own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import flat, tables

#: What the cache holds at most before it is emptied between two blocks.
CACHE_WORDS, CACHE_IDS = 400_000, 1 << 23
#: Longer words, in bytes, are merged by rank.
LONG_WORD = 64
_END = "</w>"
#: Characters that Python's str.split() takes for blanks and the vocabulary's pattern doesn't.
_CONTROL = regex.compile("[\x1c-\x1f]")
_BLANK = regex.compile(r"\p{White_Space}+")


def _ranges(text: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in text.split())


# Where the tokenizer library's character tables differ from Python's and this pattern module's.
#: Letters and numbers that count as signs.
_SIGNS = regex.compile("[" + _ranges(
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F "
    "12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
) + "]")
#: Marks that change places with no other and join no character.
_APART = regex.compile("([" + _ranges(
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 "
    "119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
) + "]+)")
#: Capital letters that Python doesn't know yet: the first and last, and what lies between them and their small letters.
_CAPITALS = (("1C89", "1C89", 1), ("A7CB", "A7CB", 0x264 - 0xA7CB), ("A7CC", "A7CC", 1), ("A7CE", "A7CE", 1), ("A7D2", "A7D2", 1), ("A7D4", "A7D4", 1), ("A7DA", "A7DA", 1), ("A7DC", "A7DC", 0x19B - 0xA7DC), ("10D50", "10D65", 32), ("16EA0", "16EB8", 27))
_SMALL = {c: c + more for first, last, more in _CAPITALS for c in range(int(first, 16), int(last, 16) + 1)}
_CAPITAL = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")


def nfc(text: str) -> str:
    """The library's NFC, which leaves the marks of ``_APART`` where they are."""
    if _APART.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(_APART.split(text)))


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


class WordBPE:
    """Encodes and decodes batches of texts as the file's own library does, special strings included."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, specials: bool = True):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]} if specials else {}
        self.size = 1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])])
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        shown = byte_symbols()
        self.inner = np.array([vocab[c] for c in shown])
        self.final = np.array([vocab[c + _END] for c in shown])
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.parts = np.array([(vocab[a], vocab[b]) for a, b in pairs])
        self.merged = np.array([vocab[a + b] for a, b in pairs])
        # a symbol's pairs nearly always rank behind the merge that makes it; where one doesn't, places merge one by one
        soonest = np.full(self.size, len(pairs))
        np.minimum.at(soonest, self.parts.ravel(), np.repeat(np.arange(len(pairs)), 2))
        self.together = soonest[self.merged] > np.arange(len(pairs))
        self.token = [b""] * self.size
        for text, k in [*vocab.items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]:
            self.token[k] = text.encode()
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | tuple[str], int] = {}
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # words ---------------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[data]
        last = np.cumsum(size) - 1
        symbol[last[size > 0]] = self.final[data[last[size > 0]]]
        word = np.repeat(np.arange(len(words)), size)
        done_symbol, done_word = [], []
        long = (size > LONG_WORD)[word]
        if long.any():
            for part, done in zip(self._by_rank(symbol[long], word[long]), (done_symbol, done_word), strict=True):
                done.append(part)
            symbol, word = symbol[~long], word[~long]
        while len(symbol):
            # the last symbol of the array has no right neighbour; nor has the last of any word
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[at] == key) & (word[:-1] == word[1:]))
            if not len(hit):
                done_symbol.append(symbol)
                done_word.append(word)
                break
            rank, of = self.ranks[at[hit]], word[hit]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            # one number orders by rank, then by place
            best = np.minimum.reduceat(rank * len(symbol) + hit, first)
            place, rank = best % len(symbol), best // len(symbol)
            symbol[place] = self.merged[rank]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            active = np.zeros(len(words), bool)
            active[of] = True
            symbol, word = symbol[keep], word[keep]
            going = active[word]
            if not going.all():
                done_symbol.append(symbol[~going])
                done_word.append(word[~going])
                symbol, word = symbol[going], word[going]
        if not done_symbol:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")  # the symbols of a word left together, in order
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _ranked(self, symbol: np.ndarray, place: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places whose symbol makes a pair of the vocabulary with the one after it, by rank, and the ranks."""
        key = symbol[place] * self.size + symbol[after]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        place, rank = place[hit], self.ranks[at[hit]]
        order = np.argsort(rank, kind="stable")
        return place[order], rank[order]

    def _by_rank(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges symbols of words, every round all places of the lowest pair; a merged place keeps its left symbol's number."""
        n = len(symbol)
        symbol = symbol.copy()
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        border = np.flatnonzero(word[:-1] != word[1:])
        right[border], left[border + 1], right[-1] = -1, -1, -1
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(place: np.ndarray) -> None:
            place = place[right[place] >= 0]
            place, rank = self._ranked(symbol, place, right[place])
            edges = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1], True]) if len(rank) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                r = int(rank[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(place[a:b])

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            place = np.sort(np.concatenate(waiting.pop(r)))
            first, second = self.parts[r]
            after = right[place]
            place = place[(symbol[place] == first) & (after >= 0) & (symbol[after] == second) & np.r_[True, place[1:] != place[:-1]]]
            after = right[place]
            if first == second and len(place):  # of places in a chain every second
                k = np.arange(len(place))
                chained = np.r_[False, place[1:] == after[:-1]]
                free = (k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0
                place, after = place[free], after[free]
            if not len(place):
                continue
            if not self.together[r]:  # the leftmost of each word, as what it makes may come before the others
                leftmost = np.r_[True, word[place[1:]] != word[place[:-1]]]
                if not leftmost.all():
                    waiting[r] = [place[~leftmost]]
                    heapq.heappush(queue, r)
                place, after = place[leftmost], after[leftmost]
            beyond = right[after]
            symbol[place], symbol[after] = self.merged[r], -1
            right[place] = beyond
            left[beyond[beyond >= 0]] = place[beyond >= 0]
            before = left[place]
            near = np.sort(np.concatenate([before[before >= 0], place]))
            wait(near[np.r_[True, near[1:] != near[:-1]]])
        return symbol[symbol >= 0], word[symbol >= 0]

    def words_of(self, chunk: str) -> list[str]:
        """The chunk's words."""
        if not chunk.isascii() and _SIGNS.search(chunk):
            return [chunk[m.start() : m.end()] for m in self.pattern.finditer(_SIGNS.sub("\u2603", chunk))]
        return self.pattern.findall(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks (text between blanks) that the cache lacks."""
        split = [self.words_of(c) for c in chunks]
        words = list({w for ws in split for w in ws})
        index = {w: k for k, w in enumerate(words)}
        ids, count = self.encode_words([w.encode("utf-8", "replace") for w in words])
        start = np.cumsum(count) - count
        part = np.fromiter((index[w] for ws in split for w in ws), np.int64)
        per = np.fromiter(map(len, split), np.int64, len(split))
        gathered = gather(ids, start[part], count[part])
        each = np.add.reduceat(np.r_[count[part], 0], np.minimum(np.cumsum(per) - per, len(part))) * (per > 0) if len(per) else per
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(each) - each]
        self.count = np.r_[self.count, each]
        self.ids = np.r_[self.ids, gathered]

    # texts ---------------------------------------------------------------------------

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = nfc(text).replace("Σ", "σ")
            if _CAPITAL.search(text):
                text = text.translate(_SMALL)
        text = text.lower()
        return text.split() if _CONTROL.search(text) is None else [c for c in _BLANK.split(text) if c]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.known) > self.cache_words or len(self.ids) > CACHE_IDS:
            self._forget()
        pieces: list[list[str | tuple[str]]] = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and "<|" in text else [text]
            chunks: list[str | tuple[str]] = []
            for k, part in enumerate(parts):
                # a special string stands for itself, under a key that is no text
                chunks += [(part,)] if k % 2 else self._chunks(part)
            pieces.append(chunks)
        known, before = self.known, len(self.known)
        flat_index = np.fromiter((known.setdefault(c, len(known)) for cs in pieces for c in cs), np.int64)
        new = list(known)[before:] if len(known) > before else []
        if new:
            self._learn(["" if isinstance(c, tuple) else c for c in new])
            for k, c in enumerate(new):
                if isinstance(c, tuple):
                    self.start[before + k], self.count[before + k] = len(self.ids), 1
                    self.ids = np.r_[self.ids, np.int32(self.special[c[0]])]
        per = np.fromiter(map(len, pieces), np.int64, len(pieces))
        count = self.count[flat_index]
        ids = gather(self.ids, self.start[flat_index], count)
        return ids, flat.per_text(count, np.repeat(np.arange(len(per)), per), len(per))

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings, joined by spaces: this vocabulary's file names no decoder."""
        return b" ".join(map(self.token.__getitem__, ids.tolist())).decode()


def gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs values[start : start + count], one after the other."""
    total = int(count.sum())
    shift = start - (np.cumsum(count) - count)
    return values[np.arange(total) + np.repeat(shift, count)] if total else values[:0]


_loaded: dict[tuple, WordBPE] = {}


def loaded(path: str, specials: bool = True) -> WordBPE:
    """One tokenizer in each Python worker."""
    if (path, specials) not in _loaded:
        _loaded[path, specials] = WordBPE(path, specials=specials)
    return _loaded[path, specials]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """Rows (id, ids): the token ids of every text, an int array. Repeated rows stay."""

    def run(batches):
        for batch in batches:
            _, offsets = flat.views(batch.column(1))
            for a, b in flat.blocks(offsets):
                ids, count = loaded(path, specials).encode(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(ids, pa.int32()))], ["id", "ids"])

    src = tables.texts(df, id_col, text_col)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): what the ids of ``encode_documents`` stand for. Null ids count as none."""

    def run(batches):
        for batch in batches:
            text = [loaded(path).decode(np.array(ids or [], np.int32)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    src = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trips(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per text: its id, the number of tokens, and hashes of the ids and of the decoded text.

    Encoding and decoding happen in one task, so that neither ids nor decoded texts are
    shuffled. ``with_ids`` returns the ids too.
    """

    def run(batches):
        for batch in batches:
            _, offsets = flat.views(batch.column(1))
            for a, b in flat.blocks(offsets):
                bpe = loaded(path)
                ids, count = bpe.encode(batch.column(1).slice(a, b - a).to_pylist())
                ends = np.cumsum(count)
                little = ids.astype("<u4")
                of_ids, of_text = [], []
                for end, n in zip(ends.tolist(), count.tolist(), strict=True):
                    of_ids.append(hashlib.sha256(little[end - n : end]).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(ids[end - n : end]).encode()).hexdigest())
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), *lists], ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    src = tables.texts(df, id_col, text_col)
    schema = f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return src.mapInArrow(run, schema + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)
