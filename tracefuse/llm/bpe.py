"""BPE encoding and decoding with tree concatenation of long unsplit text.

The tokenizer file gives normaliser, pre-tokeniser, merges and special tokens.
A text is cut at special tokens, normalised and pre-tokenised; short pieces are
merged once per distinct piece and cached.  A long piece (text the pre-tokeniser
does not split) is encoded as a tree: its leaves are encoded in parallel, and
two encoded halves are joined by re-encoding a window around the join and
growing it until its tokens meet the tokens of both sides.

Why the join is exact: a BPE token sequence is the encoding of its text exactly
when every two neighbours are the encoding of theirs.  Window and side are both
encodings; once they share a token at each end of the window, every pair of
neighbours in the spliced sequence is a pair of one of the three encodings.
If no shared token is found the window grows until it is the whole text of
both halves, which is then encoded directly.

The end-of-word mark belongs to the last character of a piece only, so inner
text is encoded by the same merges without the mark.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracefuse.llm.common import texts

#: pieces above this many characters are encoded as a tree
LONG_PIECE = 256
LEAF = 128
WINDOW = 32
#: distinct words and pieces remembered by a worker
CACHE_WORDS = 500_000
CACHE_PIECES = 300_000
#: composed Latin letters, then common marks: normalised and cut without the library
PLAIN_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_SIGNS = _byte_signs()


class BpeCodec:
    """Encoder and decoder of one tokenizer file (``tokenizers`` JSON of kind BPE)."""

    def __init__(self, path: str, long_piece: int = LONG_PIECE, leaf: int = LEAF, window: int = WINDOW):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.long_piece, self.leaf, self.window = long_piece, leaf, window
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.full = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        # the bare models take a piece as it is: with the end-of-word mark, and without it
        bare = {"version": spec["version"], "truncation": None, "padding": None, "added_tokens": [],
                "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}
        self.ending = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"]}))
        inner = spec["model"] | {"end_of_word_suffix": None} if self.suffix else spec["model"]
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": inner}))
        self.tokens: list[str] = [""] * (max([*spec["model"]["vocab"].values(),
                                              *(t["id"] for t in spec["added_tokens"])], default=-1) + 1)
        for token, i in spec["model"]["vocab"].items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.lengths = [len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.tokens]
        marks = sorted(self.special, key=len, reverse=True)
        self.special_re = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.model = self.ending.model
        # probe: does the file drop white space between pieces, so that words are independent?
        cut = self.full.pre_tokenizer
        probe = [p for p, _ in cut.pre_tokenize_str("a b\tc\nd")] if cut else []
        self.drops_space = probe == ["a", "b", "c", "d"]
        # probe: are Latin letters lower-cased and cut from a following run of marks?
        probe = self._split("Ab\u00c9\u00df.,!") if cut else []
        plain = self.drops_space and probe == ["ab\u00e9\u00df".encode().decode("latin-1").translate(BYTE_SIGNS), ".,!"]
        self.plain_word = PLAIN_WORD if plain else None

    # ---- pieces

    def _bare(self, text: str, last: bool) -> list[int]:
        model = self.ending if last else self.inner
        return model.encode(text, add_special_tokens=False).ids

    def _leaves(self, parts: Sequence[str]) -> list[list[int]]:
        """Leaves in parallel (the library's own threads); the last one ends the piece."""
        ids = [e.ids for e in self.inner.encode_batch(list(parts[:-1]), add_special_tokens=False)]
        return [*ids, self._bare(parts[-1], True)]

    def encode_long(self, piece: str) -> list[int]:
        """Tree concatenation of one piece."""
        cuts = list(range(0, len(piece), self.leaf))
        if len(cuts) > 1 and len(piece) - cuts[-1] < 2:
            cuts.pop()
        spans = list(zip(cuts, [*cuts[1:], len(piece)]))
        nodes = list(zip(spans, self._leaves([piece[a:b] for a, b in spans])))
        while len(nodes) > 1:
            joined = [self._join(piece, nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            nodes = joined + nodes[len(joined) * 2:]
        return nodes[0][1]

    def _starts(self, begin: int, ids: list[int]) -> np.ndarray:
        """Start offset of every token, and the end of the last."""
        return begin + np.concatenate([[0], np.cumsum([self.lengths[i] for i in ids], dtype=np.int64)])

    def _join(self, piece: str, left, right):
        (a, m), lids = left
        (_, b), rids = right
        last = b == len(piece)
        lpos, rpos = self._starts(a, lids), self._starts(m, rids)
        width = self.window
        while True:
            # the window begins and ends at token boundaries of the two sides
            i = max(int(np.searchsorted(lpos, m - width, "right")) - 1, 0)
            j = min(int(np.searchsorted(rpos, m + width, "left")), len(rids))
            lo, hi = int(lpos[i]), int(rpos[j])
            if lo == a and hi == b:
                return (a, b), self._bare(piece[lo:hi], last)
            ids = self._bare(piece[lo:hi], last and hi == b)
            pos = self._starts(lo, ids)
            head = 0 if lo == a else self._meet(lpos, lids, pos, ids, i, m, True)
            tail = len(ids) if hi == b else self._meet(rpos, rids, pos, ids, j, m, False)
            if head is not None and tail is not None:
                k = i if lo == a else int(np.searchsorted(lpos, pos[head]))
                n = j if hi == b else int(np.searchsorted(rpos, pos[tail]))
                return (a, b), lids[:k] + ids[head:tail] + rids[n:]
            width *= 2

    @staticmethod
    def _meet(side_pos, side_ids, pos, ids, edge, mid, left: bool):
        """Index in ``ids`` where the window takes over from a side, next to a token both have.

        Left: the token of both ends there (all before it is the side's).
        Right: the token of both begins there (all after it is the side's).
        """
        if left:
            k, w = edge, 0
            while k < len(side_ids) and w < len(ids) and side_pos[k + 1] <= mid:
                if side_pos[k] == pos[w] and side_ids[k] == ids[w] and side_pos[k + 1] == pos[w + 1]:
                    return w
                if side_pos[k + 1] <= pos[w + 1]:
                    k += 1
                else:
                    w += 1
            return None
        k, w = edge - 1, len(ids) - 1
        while k >= 0 and w >= 0 and side_pos[k] >= mid:
            if side_pos[k] == pos[w] and side_ids[k] == ids[w] and side_pos[k + 1] == pos[w + 1]:
                return w + 1
            if side_pos[k] >= pos[w]:
                k -= 1
            else:
                w -= 1
        return None

    def _piece(self, piece: str) -> tuple[int, ...]:
        if len(piece) > self.long_piece:
            return tuple(self.encode_long(piece))
        ids = tuple([t.id for t in self.model.tokenize(piece)])
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        self.cache[piece] = ids
        return ids

    # ---- texts

    def encode(self, text: str) -> np.ndarray:
        """Token ids (unsigned 32-bit) of a whole text, special tokens in it recognised."""
        out: list[int] = []
        get = self.words.get
        parts = self.special_re.split(text) if self.special_re and "<" in text else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif self.drops_space:
                # no piece spans ASCII white space, so each word is encoded once and remembered
                for word in part.encode("utf-8", "surrogatepass").split():
                    ids = get(word)
                    out += self._word(word) if ids is None else ids
            elif part:
                out += self._pieces(part)
        return np.array(out, "<u4")

    def _word(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("utf-8", "surrogatepass")
        m = self.plain_word.fullmatch(text) if self.plain_word else None
        if m:
            ids: tuple[int, ...] = ()
            for piece in m.groups():
                if piece:
                    key = piece.lower().encode().decode("latin-1").translate(BYTE_SIGNS)
                    ids += self.cache.get(key) or self._piece(key)
        else:
            ids = tuple(self._pieces(text))
        if len(word) <= self.long_piece:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _split(self, text: str) -> list[str]:
        normal, cut = self.full.normalizer, self.full.pre_tokenizer
        text = normal.normalize_str(text) if normal else text
        return [p for p, _ in cut.pre_tokenize_str(text)] if cut else [text]

    def _pieces(self, text: str) -> list[int]:
        out: list[int] = []
        get = self.cache.get
        for piece in self._split(text):
            out += get(piece) or self._piece(piece)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids, special tokens included (no decoder in the file: tokens joined by spaces)."""
        if self.full.decoder is not None:
            return self.full.decode(ids.tolist(), skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec a worker process and file."""
    return BpeCodec(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (``with_ids``) ids per row.

    ``path`` names the tokenizer file, present on every executor.

    Edge cases: a NULL text is the empty text (no tokens); texts are encoded
    whole, however long; repeated rows each get their row; an empty table gives
    an empty result; only ``doc_id`` and ``text`` are read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])

    def run(batches):
        c = codec(path)
        for b in batches:
            counts, ids_sha, decoded_sha, all_ids = [], [], [], []
            for text in texts(b.column(1)):
                ids = c.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8", "replace")).hexdigest())
                if with_ids:
                    all_ids.append(pa.array(ids.view(np.int32)))
            arrays = [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                      pa.array(decoded_sha, pa.string())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
