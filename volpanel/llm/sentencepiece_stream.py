"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary file is a byte-pair model, whose segmentation is not the one of the largest sum of scores. The Viterbi here
therefore keeps, for every boundary of the text, the one piece with which the model's segmentation of the text so far can
end: a piece may follow another exactly if the model, given those two alone, keeps the boundary between them. (No merge of
a byte-pair model crosses a boundary that stands between each two neighbours on their own, so these paths are the model's
own segmentations of all prefixes; tests hold the ids to the library's.) A back-pointer leads at most one piece back, so a
window of the longest piece's length holds all that later boundaries may use. As soon as the back-pointer paths of all
boundaries in the window lead through one boundary, the pieces before it are certain: they are committed and forgotten.
Memory thus depends on the longest piece and not on the text.

No piece has the space mark after another character, so all paths meet wherever a word begins; they also meet between two
characters that no piece has side by side. What lies between two such boundaries is committed there, remembered by the worker
and not segmented twice; only what is longer than the window needs commits on its way. Characters outside the vocabulary
become byte pieces.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded independently; an
empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from operator import add

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: A stretch between boundaries where all paths meet: spaces and the word behind them. Longer ones are not remembered.
STRETCH = re.compile(" *[^ ]+| +")
REMEMBERED_CHARS, CACHE_STRETCHES, CACHE_PARTS, CACHE_PAIRS = 64, 150_000, 200_000, 300_000
#: In place of a piece: a text's beginning, or a character of no piece, next to which nothing merges; a boundary of no path.
START, NONE = -1, -2


class Vocabulary:
    """Pieces, their merge priorities and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.piece_of = [model.id_to_piece(i) for i in range(n)]
        self.id_of = {p: i for i, p in enumerate(self.piece_of) if not special(i) and not model.is_byte(i)}
        self.rank = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.neighbours = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.utf8 = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if special(i) else self.piece_of[i].encode() for i in range(n)]
        self.finder = ahocorasick.Automaton()
        #: Of each piece, the pieces before it that were tried, and whether the model keeps the boundary.
        self.before: dict[int, dict[int, bool]] = {i: {} for i in self.id_of.values()}
        for p, i in self.id_of.items():
            self.finder.add_word(p, (len(p), i, self.before[i].get))
        self.finder.make_automaton()
        self.pairs = 0
        self.whole: dict[int, bool] = {}
        self.grown: dict[int, tuple | None] = {}

    def merged(self, text: str) -> list[str]:
        """The byte-pair segmentation of a short string: merge the best-scored neighbours, the leftmost of equals, until none."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = max(((rank[m], -i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in rank), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spines(self, piece: int) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """The first and the last part of a piece while the model builds it: (score of the merge, part), from one character on.

        None if the merges do not come in the order of their scores; such pieces need the whole segmentation.
        """
        if piece not in self.grown:
            parts, rank = list(self.piece_of[piece]), self.rank
            first, last, ordered, bound = [(1.0, parts[0])], [(1.0, parts[-1])], True, 1.0
            while len(parts) > 1:
                score, i = max(((rank[m], -i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in rank), default=(2.0, 0))
                ordered = ordered and score <= bound
                if score > 1:
                    break
                bound, i = score, -i
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    first.append((score, parts[0]))
                if i == len(parts) - 1:
                    last.append((score, parts[-1]))
            self.grown[piece] = (first, last) if ordered else None
        return self.grown[piece]

    def stands(self, piece: int) -> bool:
        """Whether the model keeps this piece as one when it is all the text."""
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = len(self.merged(self.piece_of[piece])) == 1
        return found

    def joins(self, left: int, right: int) -> bool:
        """Whether the model keeps the boundary between two pieces; after START, whether it keeps the right one."""
        if self.pairs >= CACHE_PAIRS:
            self.pairs = 0
            for known in self.before.values():
                known.clear()
        self.pairs += 1
        found = self.before[right][left] = left != NONE and (self.stands(right) if left == START else self._joins(left, right))
        return found

    def parts(self, text: str) -> list[str]:
        """text cut between characters that no piece has side by side."""
        known, at, found = self.neighbours, 0, []
        for i, pair in enumerate(map(add, text, text[1:]), 1):
            if pair not in known:
                found.append(text[at:i])
                at = i
        found.append(text[at:])
        return found

    def _joins(self, left: int, right: int) -> bool:
        a, b = self.spines(left), self.spines(right)
        if not a or not b:
            return self.merged(self.piece_of[left] + self.piece_of[right]) == [self.piece_of[left], self.piece_of[right]]
        if not self.stands(left) or not self.stands(right):
            return False
        ends, starts, rank = a[1], b[0], self.rank
        i = j = 0
        while True:  # the parts at the boundary grow in the order of their scores, unless a merge across it comes first
            across = rank.get(ends[i][1] + starts[j][1])
            on_left = ends[i + 1][0] if i + 1 < len(ends) else None
            on_right = starts[j + 1][0] if j + 1 < len(starts) else None
            if across is not None and (on_left is None or across > on_left) and (on_right is None or across >= on_right):
                return False
            if on_left is None and on_right is None:
                return True
            if on_right is None or (on_left is not None and on_left >= on_right):
                i += 1
            else:
                j += 1


class Stream:
    """Encodes one stretch after another; push() returns the ids that have become certain, finish() the rest."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.width = 0  # the largest window held so far
        self._clear()

    def _clear(self) -> None:
        self.text, self.base = "", 0  # the window's characters; the stream's offset of its first one
        self.sizes, self.pieces = [0], [START]  # per boundary of the window: length and id of the piece before it

    def push(self, text: str) -> list[int]:
        v, found = self.v, []
        for at in range(0, len(text), 4 * v.longest):
            old = len(self.text)
            self.text += text[at : at + 4 * v.longest]
            self._extend(old)
            self.width = max(self.width, len(self.text))
            if len(self.text) > v.longest:
                found += self._commit()
        return found

    def _extend(self, old: int) -> None:
        """Finds the last piece of every boundary after `old`."""
        v, sizes, pieces, text = self.v, self.sizes, self.pieces, self.text
        n = old + 1  # the boundary to decide next
        for end, (size, piece, known) in v.finder.iter(text, max(0, old - v.longest + 1)):
            if end + 1 < n:
                continue
            while n <= end:
                self._alone(n)
                n += 1
            left = pieces[n - size]
            ok = known(left)
            if ok is None:
                ok = v.joins(left, piece)
            if ok:
                sizes.append(size)
                pieces.append(piece)
                n += 1
        while n <= len(text):
            self._alone(n)
            n += 1

    def _alone(self, b: int) -> None:
        """A character that no piece has is a piece of its own."""
        self.sizes.append(1)
        self.pieces.append(NONE if self.text[b - 1] in self.v.id_of else START)

    def _commit(self) -> list[int]:
        """Emits what lies before the boundary through which the paths of the window's last boundaries all go."""
        n = len(self.text)
        alive = {b for b in range(max(0, n - self.v.longest + 1), n + 1) if self.pieces[b] != NONE}
        while len(alive) > 1:  # the furthest boundary steps back until all paths meet
            b = max(alive)
            alive.remove(b)
            alive.add(b - self.sizes[b])
        b = alive.pop()
        if not b:
            return []
        ids = self._path(b)
        self.text, self.base = self.text[b:], self.base + b
        self.sizes, self.pieces = self.sizes[b:], self.pieces[b:]
        return ids

    def _path(self, b: int) -> list[int]:
        found, sizes, pieces = [], self.sizes, self.pieces
        while b:
            piece = pieces[b]
            if piece >= 0:
                found.append(piece)
            else:
                found += [self.v.bytes[x] for x in reversed(self.text[b - 1].encode("utf-8", "surrogatepass"))]
            b -= sizes[b]
        found.reverse()
        return found

    def short(self, text: str) -> list[int]:
        """The ids of a stretch that fits into the window: all of them are certain at its end."""
        self.text = text
        self._extend(0)
        return self.finish()

    def finish(self) -> list[int]:
        """The rest: all paths meet where a stretch ends."""
        ids = self._path(len(self.text))
        self._clear()
        return ids


class Codec:
    """Encodes and decodes texts by one vocabulary, with the leading space mark that the library adds."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.stream = Stream(self.v)
        # what was met lately, and before that: stretches, and the parts that they are cut into
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _segmented(self, part: str) -> bytes:
        ids = self.old_parts.get(part)
        if ids is None:
            stream = self.stream
            ids = array("i", stream.short(part) if len(part) <= self.v.longest else stream.push(part) + stream.finish()).tobytes()
        if len(part) <= REMEMBERED_CHARS:
            if len(self.parts) >= CACHE_PARTS:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def _met(self, text: str) -> bytes:
        """The ids of a stretch that is not among those met lately."""
        ids = self.old.get(text)
        if ids is None:
            text_ = text.replace(" ", SPACE)
            ids = b"".join([self.parts.get(part) or self._segmented(part) for part in ([text_] if text[1:].isalpha() else self.v.parts(text_))])
        if len(text) <= REMEMBERED_CHARS:
            self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids."""
        if not text:
            return np.zeros(0, np.int32)
        if len(self.known) >= CACHE_STRETCHES:
            self.old, self.known = self.known, {}
        known, met = self.known, self._met
        return np.frombuffer(b"".join([known.get(part) or met(part) for part in STRETCH.findall(" " + text.replace(SPACE, " "))]), np.int32)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids, without the leading space; bytes that are no UTF-8 become replacement characters."""
        if not len(ids):
            return ""
        text = b"".join(map(self.v.utf8.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(text: Column, path: str) -> Column:
    """array<int> of ids of a text column."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = codec(path).encode
        for texts in batches:
            yield pd.Series([ids(x) for x in texts], dtype=object)

    return encoded(text)


def decode(ids: Column, path: str) -> Column:
    """string of an array<int> column of ids; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = codec(path).decode
        for rows in batches:
            yield pd.Series(["" if x is None else text(x.tolist()) for x in rows], dtype=object)

    return decoded(ids)


def encode_docs(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the column `out` of ids."""
    return docs.withColumn(out, encode(F.col(text), path))


def encoded_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, restored_sha256: the digest of the text that the ids decode to."""

    @F.pandas_udf("ids array<int>, restored_sha256 string")
    def both_ways(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in batches:
            ids = [c.encode(x) for x in texts]
            back = [hashlib.sha256(c.decode(x.tolist()).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "restored_sha256": pd.Series(back, dtype=object)})

    found = docs.select("doc_id", both_ways("text").alias("both"))
    return found.select("doc_id", F.size("both.ids").cast("long").alias("n_tokens"), F.col("both.ids").alias("ids"), F.col("both.restored_sha256").alias("restored_sha256"))
