"""Token ids of whole texts from a tokenizer file of the `tokenizers` library.

Byte-level BPE cuts a text into pieces before it merges, and no piece reaches across the place where white space follows
a character that is none. So the part between two such places always gets the same ids, and each worker asks the library
once per distinct part and remembers the answer. ASCII punctuation behind Latin letters is a piece of its own, so such
parts count as a word and its marks; words of Latin letters go to the library's merge model directly, other parts go
through all of it. Texts with runs of white space are handed to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
MARKS = r"!-/:-@\[-`{-~"
LETTERS = re.compile(f"[{LATIN}]+")
MARKED = f"^(?P<word>[{LATIN}]+)(?P<marks>[{MARKS}]+)$"


def _as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def byte_letters() -> dict[int, str]:
    """Latin letters beyond ASCII as byte-level BPE writes them: each byte of their UTF-8 form as one character, itself
    where it prints and else counted on from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letter = [chr(b if b in prints else next(others)) for b in range(256)]
    return {point: "".join(letter[b] for b in chr(point).encode()) for point in range(128, 592)}


class _Parts(dict):
    """part -> its ids as little-endian unsigned 32-bit integers, for parts that follow `lead`.

    At most about `most` parts are remembered, in two generations: once the newer one is full the older one goes, and
    what is asked for again moves to the newer one, so that common parts stay.
    """

    def __init__(self, encoder: Encoder, lead: str, most: int):
        super().__init__()
        self.encoder, self.lead, self.most, self.old = encoder, lead, most, {}

    def found(self, parts: list[str]) -> list[bytes | None]:
        """The ids of distinct parts; None for those that start or end with white space, which may belong to one piece
        with their neighbours."""
        every = []
        for at in range(0, len(parts), 50_000):
            some = parts[at : at + 50_000]
            ids = list(map(self.get, some))
            for i in [i for i, x in enumerate(ids) if x is None]:
                ids[i] = self.ask(some[i])
            every += ids
            if len(self) >= self.most // 2:
                self.old = self.copy()
                self.clear()
        return every

    def ask(self, part: str) -> bytes | None:
        ids = self.old.get(part)
        if ids is None:
            if self.encoder.direct and LETTERS.fullmatch(part):
                ids = self.encoder.piece(part, self.lead)
            elif not part or part[0].isspace() or part[-1].isspace():
                return None
            else:
                ids = self.encoder.whole(self.lead + part)
        self[part] = ids
        return ids


class _Marks(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, marks: str) -> bytes:
        if len(self) > 10_000:
            self.clear()
        self[marks] = ids = self.encoder.whole(marks)
        return ids


class Encoder:
    """Encodes like tokenizer.encode(text, add_special_tokens=False), as bytes. `most` bounds the remembered parts."""

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with_rules = json.loads(self.tokenizer.to_str())
        cut = with_rules.get("pre_tokenizer") or {}
        # pieces may go to the merge model where nothing but the byte-level rule cuts texts and no added token is a word or a mark
        self.direct = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not with_rules.get("normalizer")
            and with_rules["model"]["type"] == "BPE" and not any(re.fullmatch(f"[{LATIN}]*[{MARKS}]*", t["content"]) for t in with_rules["added_tokens"])
        )
        self.letters = byte_letters()
        self.marks = _Marks(self)
        self.first, self.later = _Parts(self, "", most // 4), _Parts(self, " ", most)
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        if not text:
            return b""
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, word: str, lead: str) -> bytes:
        """The ids of a word of Latin letters that follows `lead`, nothing or a space."""
        written = word if word.isascii() else word.translate(self.letters)
        return _as_bytes([t.id for t in self.model.tokenize("Ġ" + written if lead else written)])

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text; null counts as empty.

        Arrow numbers all parts of all texts, so that Python meets each distinct word once a call, and numpy lays the ids
        that belong to the numbers side by side.
        """
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return []
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        parts = pc.split_pattern(lines.flatten(), " ")
        line_at, part_at = lines.offsets.to_numpy() - lines.offsets[0].as_py(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        codes, parts = coded.indices.to_numpy(), coded.dictionary
        if self.direct:
            cut = pc.extract_regex(parts, MARKED)
            words = pc.if_else(cut.is_valid(), cut.field("word"), parts).dictionary_encode()
            marks = pc.if_else(cut.is_valid(), cut.field("marks"), "").dictionary_encode()
        else:
            words, marks = parts.dictionary_encode(), pc.utf8_slice_codeunits(parts, 0, 0).dictionary_encode()

        # what is laid down: a word after a space, a word that starts a line, marks behind a word, a line feed
        starts_line = np.zeros(len(codes), np.int64)
        starts_line[part_at[:-1]] = 1
        word = words.indices.to_numpy()[codes] + starts_line * len(words.dictionary)
        used = np.zeros(2 * len(words.dictionary), bool)
        used[word] = True
        known = np.flatnonzero(used)
        later, first = known[known < len(words.dictionary)], known[known >= len(words.dictionary)] - len(words.dictionary)
        names = words.dictionary.to_numpy(zero_copy_only=False)
        told = self.later.found(names[later].tolist()) + self.first.found(names[first].tolist())
        word = (np.cumsum(used) - 1)[word]
        mark = marks.indices.to_numpy()[codes] + len(told)
        told += [self.marks[m] if m else b"" for m in marks.dictionary.to_pylist()]
        told.append(self.newline)
        hard = np.array([ids is None for ids in told])
        told = [ids or b"" for ids in told] if hard.any() else told

        fed = starts_line
        fed[part_at[line_at[:-1]]] = 0  # a text's first line follows no line feed
        ends = np.cumsum(fed + 2)
        laid = np.empty(int(ends[-1]), np.int64)
        laid[ends - 1], laid[ends - 2], laid[(ends - 3)[fed == 1]] = mark, word, len(told) - 1

        n_ids = np.fromiter(map(len, told), np.int64, len(told)) // 4
        raw = _laid(np.frombuffer(b"".join(told), "<u4"), np.cumsum(n_ids) - n_ids, n_ids, laid).tobytes()
        text_at = np.concatenate(([0], ends))[part_at[line_at]]
        whole = np.add.reduceat(hard[laid], text_at[:-1]) > 0
        bounds = (4 * np.concatenate(([0], np.cumsum(n_ids[laid])))[text_at]).tolist()
        return [self.whole(texts[i].as_py() or "") if asks else raw[bounds[i] : bounds[i + 1]] for i, asks in enumerate(whole.tolist())]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _laid(pool: np.ndarray, starts: np.ndarray, n_ids: np.ndarray, slots: np.ndarray, most: int = 500_000) -> np.ndarray:
    """The ids of all slots end to end, `most` slots at a time."""
    out = []
    for at in range(0, len(slots), most):
        block = slots[at : at + most]
        n = n_ids[block]
        shift = starts[block] - (np.cumsum(n) - n)
        out.append(pool[np.repeat(shift, n) + np.arange(n.sum())])
    return np.concatenate(out) if out else pool[:0]


def encoded(batches: Iterator, path: str, end_id: int, most: int = 4_000_000) -> Iterator[tuple[int | None, bytes]]:
    """(id, ids with the end id) for every row of Arrow batches whose first two columns are an id and a text. Texts are
    encoded together up to about `most` bytes."""
    encode, end = encoder(path), _as_bytes([end_id])
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            part = batch.slice(start, stop - start)
            for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                yield key, ids + end
