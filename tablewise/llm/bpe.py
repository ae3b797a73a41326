"""Byte-level BPE by speculation and verification.

A text falls into words by the vocabulary's pattern. For every distinct word a greedy longest match
proposes tokens. A proposal is the merge result exactly when no merge crosses the border of any two
neighbours, which is tested for all neighbouring pairs at once; only words with a failing pair go
through the merges themselves, and those too are run side by side in arrays.

Both directions are maps over whole texts: no shuffle, and memory of one run of texts and a bounded
cache of words per task. Null and empty texts give no tokens; ids without a token make decoding
fail. Repeated rows give equal tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tablewise.llm.rows import with_text_columns

# fixed value: how byte-level vocabularies split a text, with white space as Unicode defines it
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_NONE = np.int64(1 << 40)
_CACHE = 300_000


def _letters() -> dict[str, int]:
    """Visible letters of a byte-level vocabulary to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_path() -> str:
    """Place of the installed public vocabulary of 50,000 byte-level tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file; picklable, to be broadcast."""

    def __init__(self, spec: dict):
        model = spec["model"]
        split = spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or odd or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        if split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        letters = _letters()
        text_ids = model["vocab"]
        self.size = 1 + max([*text_ids.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.tokens: list[bytes | None] = [None] * self.size
        for t, i in text_ids.items():
            self.tokens[i] = bytes(letters[c] for c in t)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t in spec.get("added_tokens", []):
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
                raise ValueError("added tokens that take white space along are not supported")
            self.tokens[t["id"]] = t["content"].encode()
        self.byte_ids = np.array([text_ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])])

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([text_ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([text_ids[b] for _, b in merges], dtype=np.int64)
        made = np.array([text_ids[a + b] for a, b in merges], dtype=np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.pairs = (left * self.size + right)[order]
        self.pair_rank, self.pair_made = rank[order], made[order]
        # the merge that makes each token; none for single bytes
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.rank[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = rank[::-1], left[::-1], right[::-1]

        whole = np.zeros(self.size, dtype=bool)
        whole[self.byte_ids] = True
        clean = ~self._crossed(left, right, rank, rank)
        for k in range(len(merges)):
            if self.rank[made[k]] == k:
                whole[made[k]] = clean[k] and whole[left[k]] and whole[right[k]]
        self.known = {self.tokens[i]: i for i in text_ids.values() if whole[i]}
        lengths: dict[int, int] = {}
        for t in self.known:
            lengths[t[0]] = max(lengths.get(t[0], 0), len(t))
        self.longest = [lengths.get(b, 1) for b in range(256)]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair, or none, and its place among the merges."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NONE), at

    def _crossed(self, a: np.ndarray, b: np.ndarray, before_a, before_b) -> np.ndarray:
        """Whether some merge joins the end of ``a`` with the start of ``b`` too early.

        Time runs backwards: the piece made last is taken apart first, so the pieces that meet at
        the border at any time are seen once. A merge of equal rank happens from left to right: it
        beats the merge that makes the right piece, not the one that makes the left piece.
        """
        bad = np.zeros(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        end_x, end_y = before_a.copy(), before_b.copy()
        first = True
        while len(live):
            r, _ = self._merge(x, y)
            # the pair that was asked about may merge at the very end of its time
            hit = (r < end_x) & (r < end_y if first else r <= end_y)
            bad[live[hit]] = True
            from_x = self.rank[x] > self.rank[y]
            more = ~hit & (np.maximum(self.rank[x], self.rank[y]) >= 0)
            end_x, end_y = np.where(from_x, self.rank[x], end_x), np.where(from_x, end_y, self.rank[y])
            x, y = np.where(from_x, self.right[x], x), np.where(from_x, y, self.left[y])
            live, x, y, end_x, end_y = live[more], x[more], y[more], end_x[more], end_y[more]
            first = False
        return bad

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ``a`` followed by ``b`` is how their bytes are encoded."""
        never = np.full(len(a), _NONE)
        return ~self._crossed(a, b, never, never)

    def propose(self, word: bytes) -> list[int]:
        """Longest known token at each place, from left to right."""
        known, longest, out, i, n = self.known, self.longest, [], 0, len(word)
        whole = known.get(word)
        if whole is not None:
            return [whole]
        while i < n:
            j = min(n, i + longest[word[i]])
            while (t := known.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merged(self, words: Sequence[bytes]) -> list[list[int]]:
        """Exact merges, all words side by side: in every round each word makes its first merge."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        while len(ids):
            pair = owner[:-1] == owner[1:]
            rank = np.full(len(ids), _NONE)
            at = np.zeros(len(ids), dtype=np.int64)
            r, at[:-1] = self._merge(ids[:-1], ids[1:])
            rank[:-1] = np.where(pair, r, _NONE)
            starts = np.flatnonzero(np.append(True, ~pair))
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, np.diff(np.append(starts, len(ids))))
            over = best == _NONE
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            hit = (rank == best) & ~over
            # of touching hits (a run of one letter), every second one is taken
            place = np.arange(len(ids))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= run % 2 == 1
            ids = np.where(hit, self.pair_made[at], ids)
            keep = ~over & ~np.append(False, hit[:-1])
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        return [p.tolist() for p in np.split(ids[order], ends[:-1])]


class Encoder:
    """Texts to token ids, with a bounded cache of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = regex.compile(PATTERN)
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.failed = 0
        self._start_again()

    def _start_again(self) -> None:
        self.places: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        """Tokens of words that are not in the cache yet."""
        raw = [w.encode() for w in words]
        made = [[self.v.added[w]] if w in self.v.added else self.v.propose(b) for w, b in zip(words, raw)]
        lengths = np.array([len(m) for m in made], dtype=np.int64)
        flat = np.fromiter((t for m in made for t in m), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(made)), lengths)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        seen, which = np.unique(flat[inner] * self.v.size + flat[inner + 1], return_inverse=True)
        good = self.v.compatible(seen // self.v.size, seen % self.v.size)[which]
        failing = np.unique(owner[inner[~good]])
        self.failed += len(failing)
        for i, tokens in zip(failing, self.v.merged([raw[i] for i in failing])):
            made[i] = tokens
        if len(failing):
            lengths = np.array([len(m) for m in made], dtype=np.int64)
            flat = np.fromiter((t for m in made for t in m), dtype=np.int64, count=int(lengths.sum()))
        base = len(self.flat)
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])

    def _words(self, text: str) -> list[str]:
        if self.split is None:
            return self.pattern.findall(text)
        out: list[str] = []
        for k, piece in enumerate(self.split.split(text)):
            if k % 2:
                out.append(piece)
            else:
                out += self.pattern.findall(piece)
        return out

    def __call__(self, texts: list) -> list[np.ndarray]:
        if len(self.places) > _CACHE:
            self._start_again()
        runs, fresh, places = [], [], self.places
        for t in texts:
            words = self._words((t or b"").decode("utf-8", "replace"))
            for w in set(words):
                if w not in places:
                    places[w] = len(places)
                    fresh.append(w)
            runs.append(np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words)))
        if fresh:
            self._learn(fresh)
        out = []
        for run in runs:
            n = self.lengths[run]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.starts[run] - ends + n, n) + np.arange(total)])
        return out


def decoded(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """Text of the ids; bytes that are no UTF-8 become replacement signs."""
    return b"".join(map(vocabulary.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with ``n_tokens``, ``ids`` (little-endian unsigned
    32-bit integers), the hash of each side, and the text read back from the ids as ``decoded``."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    return _encoded(docs, vocabulary, keep, whole=True)


def digests(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """As ``encode``, without the ids and the text read back."""
    return _encoded(docs, vocabulary, keep, whole=False)


def _encoded(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], whole: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # size of the vocabulary file
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def make() -> Callable[[list], list]:
        v = shared.value
        encoder = Encoder(v)

        def columns(texts: list) -> list:
            ids = encoder(texts)
            raw = [i.astype("<u4").tobytes() for i in ids]
            back = [decoded(v, i) for i in ids]
            hashes = [hashlib.sha256(r).hexdigest() for r in raw]
            texts_hash = [hashlib.sha256(t.encode()).hexdigest() for t in back]
            out = [[len(i) for i in ids], hashes, texts_hash]
            return [*out, raw, back] if whole else out

        return columns

    return with_text_columns(docs, "text", keep, added + ", ids binary, decoded string" * whole, make)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the ids) with the text of the binary ``ids`` as ``text``."""
    keep = [c for c in rows.columns if c != ids] if keep is None else keep
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def make() -> Callable[[list], list]:
        v = shared.value
        return lambda raw: [[decoded(v, np.frombuffer(r or b"", dtype="<u4")) for r in raw]]

    return with_text_columns(rows, ids, keep, "text string", make)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Pipeline: every document as token ids, with the hash of the text read back from them."""
    path = default_path() if path is None else path
    return encode(docs, Vocabulary.load(path)).drop("decoded")
