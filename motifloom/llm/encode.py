"""Whole-text token ids by the ``tokenizers`` library, with a memory of the units it has encoded.

Texts are taken apart only where the tokenizer itself always cuts: around runs of
letters, digits and other characters of ASCII, and around white space where other characters
stand.  A single space goes with what follows it.  Each unit goes to the library
once while it is remembered: to its BPE model where the tokenizer leaves the unit
in one piece, else through all of the tokenizer.  A text's ids are its units' ids put together.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from motifloom.llm.tokencount import vocabulary

#: White space as the library's patterns have it.
WIDE_BLANK = "\x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BLANK = "\t-\r " + WIDE_BLANK
UNIT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Classes of bytes.  Letters are those of ASCII, U+00C0 to U+027F and U+0400 to U+047F that have letters as lower case and stand alone in NFC.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[:128] = SIGN
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
LEADS = [*range(0xC3, 0xCA), 0xD0, 0xD1]
IS_LEAD = np.isin(np.arange(256), LEADS)
NO_LETTERS = [0xC397, 0xC3B7, 0xC4B0]  # times, divided by, and the I whose lower case is two characters
_LETTER = "(?:[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{27f}\\x{400}-\\x{47f}]+)"
#: Units that the tokenizer leaves in one piece.
ONE_PIECE = {"words": f"^ ?{_LETTER}$", "bytes": f"^(?: ?(?:{_LETTER}|[0-9]+|[^\\t-\\r 0-9A-Za-z\\x{{80}}-\\x{{10ffff}}]+)|[\\t-\\r ]+)$"}
#: Bytes as the characters that byte-level models have for them, with the separator of units as a space.
SHOWN_BYTE = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
SHOWN_BYTE |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in SHOWN_BYTE)}
SHOWN_BYTE[0xFF] = " "
#: Units of each of two generations of the memory and bytes of their text, and characters of new units that go to the library and the model at once.
REMEMBERED, REMEMBERED_BYTES, LIBRARY_CHARS, MODEL_CHARS = 400_000, 32_000_000, 200_000, 20_000
#: Units that are looked up at once.
UNITS = 1 << 20
BYTES, WORDS, WHOLE = "bytes", "words", "whole"


class Memory:
    """Ids of units, by their text."""

    def __init__(self, kind: np.dtype) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.size, self.ids = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, kind)
        self.used = self.text = 0

    def add(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.place)
        while n + len(units) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.place.update(zip(units, range(n, n + len(units))))
        self.begin[n : n + len(units)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(units)] = sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.text += sum(map(len, units))

    def places(self, units: list[bytes]) -> np.ndarray:
        """Places of units; -1 where there is none."""
        return np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))

    def taken(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at ``places`` one after another, and how many each has."""
        return self.ids[runs(self.begin[places], sizes := self.size[places])], sizes


def runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``begin, begin + 1, ...`` of each run one after another."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(begin - ends + sizes, sizes)
    return at


def offsets_of(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


class UnitEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # units are remembered here instead
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.mode = _mode(spec)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.width = np.zeros(size, np.int64)  # bytes of text behind each id
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token.removesuffix(spec["model"].get("end_of_word_suffix") or "\0"))
        for added in spec.get("added_tokens", ()):
            self.width[added["id"]] = len(added["content"].encode())
        # texts with these are cut in front of white space only: added tokens, and for byte-level words white space beyond ASCII
        apart = [re.escape(added["content"]) for added in spec.get("added_tokens", ())] + ([f"[{WIDE_BLANK}]"] if self.mode == BYTES else [])
        self.apart = "|".join(apart)
        self.memory, self.older = Memory(self.kind), Memory(self.kind)

    def encode_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_joint(self, tokenizer, shown: list[str], sizes: list[int], joint: str, most: int) -> list[tuple[int, int, np.ndarray, np.ndarray] | None]:  # noqa: ANN001
        """From, to, ids and number of ids of each of runs of texts that ``tokenizer`` sees with ``joint`` between; no ids where it changes their sizes."""
        out, ends = [], np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(shown)]
        for at, stop in zip(cuts, cuts[1:]):
            ids = np.array(tokenizer.encode_batch_fast([joint.join(shown[at:stop])], add_special_tokens=False)[0].ids, self.kind)
            reached, wanted = np.cumsum(self.width[ids]), ends[at:stop] - (ends[at - 1] if at else 0)
            found = np.searchsorted(reached, wanted, "left")
            fits = len(ids) and found[-1] == len(ids) - 1 and (reached[found] == wanted).all()
            out.append((at, stop, ids, np.diff(found, prepend=-1)) if fits else (at, stop, None, None))
        return out

    def learn_library(self, units: list[bytes], shown: list[str], sizes: list[int] | None, joint: str = "") -> None:
        """Remember the ids of units that the whole tokenizer sees as ``shown``, alone or where sizes are given with ``joint`` between."""
        parts = [(0, len(units), None, None)] if sizes is None else self.encode_joint(self.library, shown, sizes, joint, LIBRARY_CHARS)
        for at, stop, ids, counts in parts:
            if ids is None:
                each = self.encode_library(shown[at:stop])
                ids, counts = np.concatenate([np.zeros(0, self.kind), *each]), np.array([len(e) for e in each], np.int64)
            self.memory.add(units[at:stop], ids, counts)

    def learn(self, units: list[bytes]) -> None:
        one_piece = pc.match_substring_regex(pa.array(units, pa.binary()).cast(pa.string()), ONE_PIECE[self.mode]).to_numpy(zero_copy_only=False)
        whole, rest = list(compress(units, one_piece.tolist())), list(compress(units, (~one_piece).tolist()))
        if whole:
            if self.mode == WORDS:
                text = b" ".join(whole).decode().lower()
                shown = (text if text.isascii() else text.encode().decode("latin-1").translate(SHOWN_BYTE | {32: " "})).split()
            else:
                shown = b"\xff".join(whole).decode("latin-1").translate(SHOWN_BYTE).split(" ")
            number: dict[str, int] = {}
            same = np.fromiter([number.setdefault(w, len(number)) for w in shown], np.int64, len(shown))
            words = list(number)
            parts = self.encode_joint(self.model, words, list(map(len, words)), " ", MODEL_CHARS)
            if all(ids is not None for _, _, ids, _ in parts):
                ids, counts = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
                self.memory.add(whole, ids[runs((np.cumsum(counts) - counts)[same], counts[same])], counts[same])
            else:  # a model that drops or changes characters
                rest += whole
        if self.mode == WORDS:
            shown = [u.decode().strip(" ") for u in rest]
            blank = [k for k, s in enumerate(shown) if not s.strip("\t\n\x0b\x0c\r ")]
            if blank:
                self.memory.add([rest[k] for k in blank], np.zeros(0, self.kind), np.zeros(len(blank), np.int64))
                rest, shown = [u for u, s in zip(rest, shown) if s.strip("\t\n\x0b\x0c\r ")], [s for s in shown if s.strip("\t\n\x0b\x0c\r ")]
            if rest:
                self.learn_library(rest, shown, [len(unicodedata.normalize("NFC", s).lower().encode()) for s in shown], " ")
        elif rest:
            # a unit behind another one is cut off where a space follows something else
            joined = [u for u in rest if u[:1] == b" " and not u.decode()[-1].isspace()]
            if joined:
                self.learn_library(joined, [u.decode() for u in joined], list(map(len, joined)))
            if len(joined) < len(rest):
                alone = list(set(rest) - set(joined))
                self.learn_library(alone, [u.decode() for u in alone], None)

    def places(self, units: list[bytes]) -> np.ndarray:
        """Places of units in the memory, which learns those that it does not hold."""
        places = self.memory.places(units)
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            if len(self.memory.place) + len(fresh) > REMEMBERED or self.memory.text > REMEMBERED_BYTES:  # what is not used again falls out with the older generation
                self.older, self.memory = self.memory, Memory(self.kind)
                fresh = np.arange(len(units))
            new = [units[k] for k in fresh.tolist()]
            before = self.older.places(new)
            again = np.flatnonzero(before >= 0)
            if len(again):
                self.memory.add([new[k] for k in again.tolist()], *self.older.taken(before[again]))
                new = [new[k] for k in np.flatnonzero(before < 0).tolist()]
            if new:
                self.learn(new)
            places = self.memory.places(units)
        return places

    def starts(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where units begin.

        Runs of a class of bytes are units, a single space with what follows it.  What stands between
        white space stays whole if it has a byte of the class OTHER, and letters stay with an apostrophe
        that stands alone in front of them, for contractions.
        """
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True  # that of a text, also of an empty one, whose place is that of the next
        kinds = CLASS[data]
        leads = np.flatnonzero(IS_LEAD[data])
        if len(leads):
            pair = data[leads].astype(np.int64) << 8 | data[leads + 1]
            letters = leads[~np.isin(pair, NO_LETTERS)]
            kinds[letters] = kinds[letters + 1] = LETTER
        run = np.flatnonzero(np.append(begins[0], (kinds[1:] != kinds[:-1]) | begins[1:-1])) if len(data) else np.zeros(0, np.int64)
        kind, new = kinds[run], begins[run]
        after_space = np.append(False, kind[:-1] == SPACE)
        token = np.cumsum(new | after_space | (kind == SPACE)) - 1
        other = np.bincount(token, kind == OTHER)[token] > 0 if len(run) else np.zeros(0, bool)
        short = np.append(False, (np.diff(run) == 1) & (data[run[:-1]] == ord("'"))) if len(run) else np.zeros(0, bool)
        kept = new | after_space | (kind == SPACE) | ~(other | short & (kind == LETTER))
        begins[run[kept]] = True
        behind = run[after_space & ~new]  # a space in front of something else goes with it
        begins[behind - 1] = True
        begins[behind[data[behind - 1] == 32]] = False
        if self.apart:
            for k in np.flatnonzero(pc.match_substring_regex(column, self.apart).to_numpy(zero_copy_only=False)).tolist():
                begins[offsets[k] + 1 : offsets[k + 1]] = False
                sizes = [len(u.encode()) for u in UNIT.findall(column[k].as_py())]
                begins[offsets[k] + np.cumsum(sizes[:-1], dtype=np.int64)] = True
        return np.flatnonzero(begins[:-1])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column one after another, and how many each has; null is empty."""
        if column.null_count:
            column = column.fill_null("")
        if self.mode == WHOLE:
            each = self.encode_library(column.to_pylist())
            return np.concatenate([np.zeros(0, self.kind), *each]), np.array([len(e) for e in each], np.int64)
        offsets = offsets_of(column)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        starts = self.starts(column, data, offsets)
        parts, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for k in range(0, len(starts), UNITS):
            cuts = np.append(starts[k : k + UNITS], starts[k + UNITS] if k + UNITS < len(starts) else len(data))
            own = pa.py_buffer(np.ascontiguousarray(data[cuts[0] : cuts[-1]]))
            units = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts - cuts[0]).astype(np.int32)), own]).dictionary_encode()
            places = self.places(units.dictionary.to_numpy(zero_copy_only=False).tolist())[units.indices.to_numpy()]
            ids, counts = self.memory.taken(places)
            parts.append(ids)
            sizes.append(counts)
        ends = np.append(0, np.cumsum(np.concatenate(sizes)))
        return np.concatenate(parts), np.diff(ends[np.searchsorted(starts, offsets)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, in ``kind``."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        raw, cuts = ids.tobytes(), np.append(0, np.cumsum(counts) * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_documents(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_column`, with ``end_id`` behind each text."""
        ids, counts = self.encode_column(column)
        return (ids, counts) if end_id is None else (np.insert(ids, np.cumsum(counts), end_id), counts + 1)


def _mode(spec: dict) -> str:
    """Where a tokenizer may be cut: byte-level words with their leading space, words without white space, or nowhere."""
    before, shape = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    plain = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized") and shape) and not re.search(f"[{BLANK}]", a["content"]) for a in spec.get("added_tokens", ()))
    if not plain or spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        return WHOLE
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and shape is None:
        return BYTES
    if before.get("type") == "Sequence" and shape and [n["type"] for n in shape.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]:
        first = before["pretokenizers"][0]
        if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]:
            return WORDS
    return WHOLE


_MADE: dict[str, UnitEncoder] = {}


def encoder(name: str) -> UnitEncoder:
    """The worker's encoder of a vocabulary (a public name or a path); it stays between tasks."""
    if name not in _MADE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _MADE[name] = UnitEncoder(name if os.path.sep in name else vocabulary(name))
    return _MADE[name]


def text_slices(column: pa.Array, limit: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Runs of an Arrow string column of about ``limit`` bytes: (from, texts)."""
    ends, begin = offsets_of(column), 0
    while begin < len(column):
        stop = min(len(column), max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1))
        yield begin, column.slice(begin, stop - begin)
        begin = stop
