"""Exact encoding of texts with a merge-type SentencePiece model, and decoding.

A sequence of pieces is the one that merging gives if merging the characters of
each two neighbours gives just these two. So pieces are taken from the left, the
longest match first, all matches found by one Aho-Corasick pass; a piece that
doesn't go with the one before gives way to a shorter one, and where none is
left the piece before is taken back. A start's encoding is unique, so a position
once left is marked in a bitfield and never entered again, and work is linear in
the text. Pieces that merging their own characters doesn't give are never used.

Models have merge-type pieces and byte fallback: characters that are no piece
become the pieces of their bytes. Null texts count as empty and have no ids.
Repeated rows, ids and null ids are rows of their own. Other columns are ignored.
An empty table gives no rows.
"""

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the character that stands for a space.
SPACE = "▁"
#: Encoded stretches, and judged neighbours, that a worker remembers; longer stretches are not kept.
KNOWN, KNOWN_CHARS = 400_000, 64
#: Characters that are cut into stretches at once.
WINDOW = 1 << 18
#: Ids, or characters, that a task holds before it gives rows on.
FLUSH = 1 << 20


def stretches(joined: set[str]) -> str:
    """A pattern that cuts texts where no piece reaches over, from the pairs of characters that stand side by side in pieces.

    Characters that pieces join, directly or through others, are one class. A
    space may begin any stretch if no piece has one after another character.
    """
    first = not any(x[0] != SPACE and x[1] == SPACE for x in joined)
    of: dict[str, set[str]] = {}
    for x in joined:
        if not (first and x[0] == SPACE):
            both = sorted((of.setdefault(c, {c}) for c in x), key=len)
            if both[0] is not both[1]:
                both[1].update(both[0])
                of.update(dict.fromkeys(both[0], both[1]))
    classes = sorted({id(c): "".join(sorted(c)) for c in of.values()}.values(), key=len, reverse=True)
    lead, space = (f"{SPACE}*", SPACE) if first else ("", "")
    ways = [f"{lead}[{re.escape(c)}]+" for c in classes] + [f"{lead}[^{space}{re.escape(''.join(classes))}]+"]
    return "|".join([*ways, f"{SPACE}+"] if first else ways)


class PieceModel:
    """A model's pieces, and what encoding needs of them."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(lib.get_piece_size())
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte fallback")
        plain = [i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        used = [p for p in self.ids if len(p) > 1 and self.merged(p) == [p]]
        self.matches = ahocorasick.Automaton()
        for p in used:
            self.matches.add_word(p, len(p))
        self.matches.make_automaton()
        usable = set(used)
        self.shorter = {p: next((k for k in range(len(p) - 1, 1, -1) if p[:k] in usable), 1) for p in used}
        self.joined = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.stretch = re.compile(stretches(self.joined))
        self.judged: dict[tuple[str, str], bool] = {}
        self.known = _Known(self.stretch_ids)

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best pair first, of equals the left one."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces may stand beside each other: merging both together gives just them."""
        found = self.judged.get((left, right))
        if found is None:
            if len(self.judged) >= KNOWN:
                self.judged.clear()
            found = left[-1] + right[0] not in self.joined or self.merged(left + right) == [left, right]
            self.judged[left, right] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a stretch of text; a character that is no piece stands alone."""
        n, pos, out, shorter, judged = len(text), 0, [], self.shorter, self.judged
        longest = [1] * n if n <= KNOWN_CHARS else array("H", [1]) * n
        for end, size in self.matches.iter(text):
            longest[end - size + 1] = size
        failed, any_failed = bytearray(n // 8 + 1), False
        token = text[: longest[0]]
        while True:
            end = pos + len(token)
            if any_failed and failed[end >> 3] >> (end & 7) & 1:
                good = False
            elif out:
                good = judged.get((out[-1], token))
                if good is None:
                    good = self.fits(out[-1], token)
            else:
                good = True
            if good:
                out.append(token)
                if end == n:
                    return out
                pos = end
                token = text[pos : pos + longest[pos]]
            elif len(token) > 1:
                token = token[: shorter[token]]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                any_failed = True
                token = out.pop()
                pos -= len(token)

    def stretch_ids(self, stretch: str) -> bytes:
        parts = self.split(stretch)
        ids = list(map(self.ids.get, parts))
        if None in ids:
            ids = [i for p, i in zip(parts, ids, strict=True) for i in ([i] if i is not None else [self.bytes[b] for b in p.encode()])]
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, a window at a time; a window's last stretch may go on and is left to the next."""
        text, parts, at, size = self.library.normalize(text), [], 0, WINDOW
        while at < len(text):
            found = self.stretch.findall(text[at : at + size])
            if at + size < len(text):
                at += size - len(found.pop())
                size = WINDOW if found else 2 * size
            else:
                at = len(text)
            parts.append(b"".join(map(self.known.__getitem__, found)))
        return np.frombuffer(b"".join(parts), np.int32)


class _Known(dict):
    """The ids of stretches, made where they are missing."""

    def __init__(self, made):
        self.made = made

    def __missing__(self, stretch: str) -> bytes:
        ids = self.made(stretch)
        if len(stretch) <= KNOWN_CHARS:
            if len(self) >= KNOWN:
                self.clear()
            self[stretch] = ids
        return ids


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _rows(docs: DataFrame, path: str, back: bool) -> DataFrame:
    kept = docs.select("doc_id", "text")
    fields = [kept.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType(fields + [T.StructField("text", T.StringType())] if back else fields)

    def run(batches):
        m = model(path)
        for batch in batches:
            rows, texts, held, start = [], [], 0, 0
            for k, t in enumerate(batch.column("text")):
                rows.append(m.encode(t.as_py() or ""))
                if back:
                    texts.append(m.library.decode(rows[-1].tolist()) or "")
                held += len(rows[-1])
                if held >= FLUSH or k == batch.num_rows - 1:
                    ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows), pa.int32()))
                    columns = [batch.column("doc_id").slice(start, len(rows)), lists] + ([pa.array(texts, pa.string())] if back else [])
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
                    rows, texts, held, start = [], [], 0, k + 1

    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of docs(doc_id, text), without begin or end ids."""
    return _rows(docs, path, False)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """encode's columns + text, the text that `decode` makes of the ids, in one pass."""
    return _rows(docs, path, True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) + text, as the library gives it back; no ids give an empty text."""
    kept = encoded.select("doc_id", "ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        library = model(path).library
        for batch in batches:
            texts, held, start = [], 0, 0
            for k, ids in enumerate(batch.column("ids")):
                texts.append(library.decode(ids.as_py() or []) or "")
                held += len(texts[-1])
                if held >= FLUSH or k == batch.num_rows - 1:
                    rows = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                    texts, held, start = [], 0, k + 1

    return kept.mapInArrow(run, schema)
