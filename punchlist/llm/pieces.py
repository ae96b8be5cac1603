"""SentencePiece encoding and decoding of a public BPE vocabulary by suffix-array matching.

The distinct words of a batch are joined into one text, whose suffixes are sorted by as many characters as the longest piece
has. Two binary searches per piece give the range of suffixes that begin with it, so all its occurrences. These are the edges
of a lattice; sorted by the position they end at, they are relaxed in one pass: exactly one edge into each position continues
the encoding of what precedes it. Which one is decided by compatibility of neighbours: two pieces stand side by side in an
encoding exactly if, undoing their merges from the last one back, no merge across their border would have come first. So the
result is that of merging by rank, byte fallback included.

Blanks are written as U+2581, one is put before the text, and characters that are no piece become bytes.

Defined results: a null or empty text has no ids. A U+2581 in a text decodes to a blank, as it does for the vocabulary's own
library; any other text is decoded exactly. Rows that repeat a ``doc_id`` each get a result. Other columns are ignored; an
empty table gives no rows. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANK = "\N{LOWER ONE EIGHTH BLOCK}"
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Characters of texts that are encoded together, and of distinct words that are indexed together; and rows held as texts.
SLICE, INDEXED, ROWS = 6_000_000, 200_000, 2_000


def _merged(symbols: list[str], score: dict[str, float]) -> list[tuple[str, str]]:
    """Merges symbols by score, leftmost first; the last entries of the result are the merges made, in order."""
    made = []
    symbols = list(symbols)
    while True:
        best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score), default=None)
        if best is None:
            return [*made, ("", "\0".join(symbols))]
        i = -best[1]
        made.append((symbols[i], symbols[i + 1]))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


class Vocabulary:
    """Pieces and the tables that compatibility needs. Made on the driver and sent to the workers."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        special = [i for i in range(self.size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        self.bytes = np.full(256, -1, np.int32)
        for i in range(self.size):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[1:-1], 16)] = i
        skip = {*special, *self.bytes.tolist()}
        self.pieces = {model.id_to_piece(i): i for i in range(self.size) if i not in skip}
        score = {p: model.get_score(i) for p, i in self.pieces.items()}
        self.decoded = [b"" if i in special else model.id_to_piece(i).encode() for i in range(self.size)]
        for value, i in enumerate(self.bytes.tolist()):
            self.decoded[i] = bytes([value])

        # Ranks of merges: -1 for what is not merged; the symbol for characters that are no piece has number ``size``.
        order = sorted({s for p, s in score.items() if len(p) > 1}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.arange(self.size + 1), np.arange(self.size + 1)
        self.usable = np.zeros(self.size + 1, bool)
        self.usable[self.size] = True
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.usable[i] = True
                continue
            made = _merged(list(p), score)
            if made[-1][1] == p:
                a, b = made[-2]
                self.usable[i], self.rank[i] = True, place[score[p]]
                self.left[i], self.right[i] = self.pieces[a], self.pieces[b]
        # Undoing merges from the last one back needs ranks that grow from parts to wholes; other pieces are simulated.
        self.odd = np.zeros(self.size + 1, bool)
        for p in sorted(self.pieces, key=len):
            i = self.pieces[p]
            a, b = self.left[i], self.right[i]
            if self.rank[i] >= 0:
                self.odd[i] = self.rank[i] <= max(self.rank[a], self.rank[b]) or self.odd[a] or self.odd[b]
        pairs = {}
        for p, i in self.pieces.items():
            for cut in range(1, len(p)):
                a, b = self.pieces.get(p[:cut]), self.pieces.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * (self.size + 1) + b] = place[score[p]]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.names, self.score, self.simulated = {i: p for p, i in self.pieces.items()}, score, {}
        self.longest = max(map(len, self.pieces))
        usable = [(p, i) for p, i in self.pieces.items() if self.usable[i]]
        self.letter_ids = np.array([i for _, i in usable], np.int64)
        self.letters = np.frombuffer("".join(p.ljust(self.longest, "\0") for p, _ in usable).encode("utf-32-le"), np.uint32).reshape(-1, self.longest)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the two pieces stay as they are side by side."""
        ok = np.ones(len(first), bool)
        odd = np.flatnonzero(self.odd[first] | self.odd[second])
        for i in odd.tolist():
            ok[i] = self._simulate(int(first[i]), int(second[i]))
        live = np.flatnonzero(~(self.odd[first] | self.odd[second]))
        a, b, limit = first[live], second[live], np.full(len(live), 1 << 60)
        while len(live):
            key = a * (self.size + 1) + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == key) & (2 * self.pair_ranks[at] < limit)
            ok[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            # The later merge is undone; of equal ones the right one, as the left one is made first.
            last = ra > rb
            limit = np.where(last, 2 * ra, 2 * rb + 1)
            a, b = np.where(last, self.right[a], a), np.where(last, b, self.left[b])
        return ok

    def _simulate(self, first: int, second: int) -> bool:
        if first == self.size or second == self.size:
            return True
        if (first, second) not in self.simulated:
            a, b = self.names[first], self.names[second]
            self.simulated[first, second] = _merged([*a, *b], self.score)[-1][1] == f"{a}\0{b}"
        return self.simulated[first, second]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin (one more at the end)."""
        text = "\0".join(words) + "\0"  # a NUL in a word is no piece either
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        start, piece, length = self._occurrences(codes)

        # Borders that no occurrence spans cut the text into runs that are encoded independently.
        spanned = np.bincount(start + 1, minlength=len(codes) + 1) - np.bincount(start + length, minlength=len(codes) + 1)
        begins_run = np.cumsum(spanned)[: len(codes)] == 0
        run = np.maximum.accumulate(np.where(begins_run, np.arange(len(codes)), 0))
        level = start - run[start] + length
        order = np.argsort(level, kind="stable")
        start, piece, length, level = start[order], piece[order], length[order], level[order]
        last, size = np.full(len(codes) + 1, -1, np.int64), np.ones(len(codes) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(level, prepend=0)).tolist() + [len(level)]
        for lo, hi in zip(cuts, cuts[1:]):
            s, t, n = start[lo:hi], piece[lo:hi], length[lo:hi]
            fits = begins_run[s].copy()
            inner = np.flatnonzero(~fits & (last[s] >= 0))
            fits[inner] = self.compatible(last[s[inner]], t[inner])
            last[s[fits] + n[fits]], size[s[fits] + n[fits]] = t[fits], n[fits]

        # Back from the ends of runs.
        at = np.append(np.flatnonzero(begins_run)[1:], len(codes))
        ends = []
        while len(at):
            ends.append(at)
            before = at - size[at]
            at = before[~begins_run[before]]
        ends = np.sort(np.concatenate(ends))
        ids, places = last[ends], ends - size[ends]
        return self._with_bytes(ids, places, codes, begins)

    def _occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece, length) of all occurrences of pieces, and of every character that is none."""
        used, small = np.unique(codes, return_inverse=True)
        small = small.astype(np.int64) + 1
        bits = int(len(used) + 1).bit_length()
        per = 62 // bits
        words = -(-self.longest // per)
        padded = np.concatenate([small, np.zeros(words * per, np.int64)])
        packed = np.zeros(len(codes) + (words - 1) * per, np.int64)
        for i in range(per):
            packed = packed << bits | padded[i : i + len(packed)]
        keys = [packed[w * per : w * per + len(codes)] for w in range(words)]
        suffixes = np.lexsort(keys[::-1])
        head = keys[0][suffixes]

        # Each piece as numbers of this text's characters: the rest is filled with the least for the low end of its range and
        # with the most for the high end.
        place = np.minimum(np.searchsorted(used, self.letters), len(used) - 1)
        filled = self.letters != 0
        present = (~filled | (used[place] == self.letters)).all(axis=1)
        low = np.zeros((int(present.sum()), words * per), np.int64)
        low[:, : self.longest] = np.where(filled, place + 1, 0)[present]
        high = np.where(low > 0, low, (1 << bits) - 1)
        known, sizes = self.letter_ids[present], filled.sum(axis=1)[present]
        lows, highs = np.zeros((words, len(known)), np.int64), np.zeros((words, len(known)), np.int64)
        for i in range(words * per):
            lows[i // per] = lows[i // per] << bits | low[:, i]
            highs[i // per] = highs[i // per] << bits | high[:, i]
        first, end = np.searchsorted(head, lows[0], "left"), np.searchsorted(head, highs[0], "right")
        for j in np.flatnonzero((sizes > per) & (first < end)).tolist():
            for w in range(1, words):  # within the range of equal beginnings the next characters are in order
                tail = keys[w][suffixes[first[j] : end[j]]]
                end[j] = first[j] + np.searchsorted(tail, highs[w, j], "right")
                first[j] += np.searchsorted(tail, lows[w, j], "left")
        n = end - first
        where = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        start = suffixes[where]
        piece, length = np.repeat(known, n), np.repeat(sizes, n)
        single = np.array([self.pieces.get(chr(c)) is None for c in used.tolist()])
        unknown = np.flatnonzero(single[small - 1])
        return np.concatenate([start, unknown]), np.concatenate([piece, np.full(len(unknown), self.size)]).astype(np.int64), np.concatenate([length, np.ones(len(unknown), np.int64)]).astype(np.int64)

    def _with_bytes(self, ids: np.ndarray, places: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts bytes for characters that are no piece, and drops the ends of words."""
        word = np.searchsorted(begins, places, "right") - 1
        inside = places != begins[word + 1] - 1
        ids, places, word = ids[inside], places[inside], word[inside]
        chars = codes[places]
        unknown = ids == self.size
        n = np.where(unknown, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 1)
        out = np.repeat(ids, n)
        at = np.concatenate([[0], np.cumsum(n)])[:-1]
        for i in np.flatnonzero(unknown).tolist():
            raw = chr(chars[i]).encode("utf-8", "surrogatepass")
            out[at[i] : at[i] + len(raw)] = self.bytes[list(raw)]
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, n, minlength=len(begins) - 1))]).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        place: dict[str, int] = {}
        flat, sizes = array("i"), []
        for t in texts:
            before = len(flat)
            if t:
                flat.extend([place.setdefault(w, len(place)) for w in WORDS.findall(BLANK + t.replace(" ", BLANK))])
            sizes.append(len(flat) - before)
        flat = np.array(flat, np.int64)
        words, ids, begins, base, group, chars = list(place), [], [], 0, [], 0
        for i, w in enumerate(words):
            group.append(w)
            chars += len(w) + 1
            if chars >= INDEXED or i == len(words) - 1:
                own, at = self.encode_words(group)
                ids.append(own)
                begins.append(at[:-1] + base)
                base, group, chars = base + len(own), [], 0
        ids = np.concatenate([*ids, np.zeros(0, np.int32)])
        begins = np.concatenate([*begins, [base]]).astype(np.int64)
        n = np.diff(begins)[flat]
        ends = np.concatenate([[0], np.cumsum(n)])
        own = ids[np.repeat(begins[flat] - ends[:-1], n) + np.arange(ends[-1])]
        ends = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return [own[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def _encoded(shared):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # few texts are held as such at a time
                batch = whole.slice(at, ROWS)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                first = 0
                while first < len(texts):
                    end, chars = first, 0
                    while end < len(texts) and (end == first or chars + len(texts[end]) <= SLICE):
                        chars += len(texts[end])
                        end += 1
                    ids = vocabulary.encode(texts[first:end])
                    same = [vocabulary.decode(i) == t.replace(BLANK, " ") for i, t in zip(ids, texts[first:end])]
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists, pa.array(same)], names=["doc_id", "ids", "round_trip"])
                    first = end
            pa.default_memory_pool().release_unused()

    return of_batches


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, ids and whether decoding gives the text again, one row per row of ``docs``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_encoded(vocabulary), f"doc_id {kind}, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and text of ids."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [vocabulary.value.decode(np.array(i or [], np.int32)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(of_batches, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
