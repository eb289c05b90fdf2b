"""Token ids of whole texts, from the tokenizers library.

Byte-level BPE cuts a text into pieces and merges within each piece alone, so
the ids of a text are those of its stretches between single spaces or line
ends, each with the space or line end before it. `Encoder` cuts a batch of texts there, has
the library encode each different stretch once and puts the ids together. A
text where that would not be exact (neighbouring or other white space, the
string of a special token, the mark itself) goes to the library as a whole, as
does every text if the tokenizer's file is not of that kind.

What an encoder remembers is bounded in bytes: beyond that the half that was
met more often stays. Nothing but speed depends on what it remembers.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are encoded as a whole: white space that is not one space or line end, the mark, a special token's start.
WHOLE = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x01]|[ \\n][ \\n]|<\\|"
MARK = "\x01"
#: How a space and a line end are written in a byte-level vocabulary.
BLANKS = "\u0120\u010a"
#: Bytes of stretches and ids that an encoder remembers, and what one of them costs besides its characters and ids.
REMEMBERED, EACH = 96_000_000, 160
#: Texts of about so many bytes are put together at once; so many stretches go to the library at once.
AT_ONCE, STRETCHES = 4_000_000, 8192


class Encoder:
    """Encodes batches of texts; one for each worker and tokenizer file."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = self._cuts_at_blanks()
        self.ends = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,"} if self.cuts else {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True) if self.cuts else {}
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] in BLANKS]] = True
        self.known: dict[str, int] = {}
        self.pool, self.used, self.cost = np.empty(1 << 20, np.int32), 0, 0
        self.at, self.size, self.met = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32), np.zeros(1 << 18, np.int32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _cuts_at_blanks(self) -> bool:
        """Whether the file says that pieces are cut before blanks, bytes are merged within pieces, and texts are not changed before or after."""
        said = json.loads(self.tokenizer.to_str())
        cut, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        return (
            (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True), model.get("type")) == ("ByteLevel", False, True, "BPE")
            and not (said.get("normalizer") or said.get("truncation") or said.get("padding") or model.get("dropout") or model.get("unk_token"))
            and all(t["content"].startswith("<|") for t in said.get("added_tokens", []))
        )

    def _forget(self) -> None:
        """Keeps the half that was met more often."""
        n = len(self.known)
        stay = np.sort(np.argsort(self.met[:n], kind="stable")[n // 2 :])
        keys, sizes, ids = list(self.known), self.size[stay].copy(), self._gathered(stay)
        met = self.met[stay] // 2
        self.known, self.used, self.cost = {}, 0, 0
        self._store([keys[i] for i in stay.tolist()], sizes.astype(np.int64), ids)
        self.met[: len(met)] = met

    def _store(self, keys: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remembers that each of keys, all new and different, has so many of the ids in a row."""
        first, total = len(self.known), len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while first + len(keys) > len(self.at):
            self.at, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.met))
        self.pool[self.used : self.used + total] = ids
        self.at[first : first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(keys)] = sizes
        self.met[first : first + len(keys)] = 0
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.used += total
        self.cost += sum(map(len, keys)) + 4 * total + EACH * len(keys)

    def _gathered(self, places: np.ndarray) -> np.ndarray:
        """The ids of the stretches known under places, in a row."""
        sizes = self.size[places].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.at[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _encoded(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the stretches has, and all their ids in a row.

        Those with a blank before them are encoded as one text: the library takes a third of the time for that, and
        each begins with the one id in it that begins with a blank. The others, and all if that fails, are texts of their own.
        """
        joined = [s[0] != MARK and s != "\n" for s in stretches]
        texts = [s.lstrip(MARK) if s[0] in "\n\x01" else " " + s for s in stretches]
        row = self.tokenizer.encode_batch_fast(["".join(compress(texts, joined))], add_special_tokens=False)[0].ids
        row, fit = np.array(row, np.int32), np.array(joined, bool)
        starts = np.flatnonzero(self.begins[row])
        if len(starts) != fit.sum() or (len(row) and not self.begins[row[0]]):
            row, starts, fit = row[:0], starts[:0], np.zeros(len(stretches), bool)
        sizes = np.zeros(len(stretches), np.int64)
        sizes[fit] = np.diff(np.append(starts, len(row)))
        if fit.all():
            return sizes, row
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(list(compress(texts, ~fit)), add_special_tokens=False)]
        sizes[~fit] = np.fromiter(map(len, alone), np.int64, len(alone))
        ids, in_row = np.empty(int(sizes.sum()), np.int32), np.repeat(fit, sizes)
        ids[in_row], ids[~in_row] = row, np.fromiter(chain.from_iterable(alone), np.int32)
        return sizes, ids

    def _learn(self, stretches: list[str]) -> None:
        """Remembers the ids of new stretches; a last [.,] after a letter is a piece of its own, so the rest is shared."""
        bases = [s[:-1] if s[-1] in ".," and s[-2:-1].isalpha() else s for s in stretches if s]
        new = list(dict.fromkeys(b for b in bases if b not in self.known))
        for at in range(0, len(new), STRETCHES):
            self._store(new[at : at + STRETCHES], *self._encoded(new[at : at + STRETCHES]))
        if "" in stretches:
            alone = self.tokenizer.encode(" ", add_special_tokens=False).ids
            self._store([""], np.array([len(alone)]), np.array(alone, np.int32))
        ended = [(s, b) for s, b in zip(filter(None, stretches), bases, strict=True) if s is not b and s not in self.known]
        if ended:
            places = np.fromiter((self.known[b] for _, b in ended), np.int64, len(ended))
            sizes = self.size[places].astype(np.int64)
            marks = np.array([self.ends[s[-1]] for s, _ in ended], np.int32)
            self._store([s for s, _ in ended], sizes + 1, np.insert(self._gathered(places), np.cumsum(sizes), marks))

    def _places(self, different: np.ndarray) -> np.ndarray:
        """The numbers under which the ids of stretches are known."""
        if self.cost > REMEMBERED:
            self._forget()
        places = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(places < 0)
        if len(new):
            self._learn(different[new].tolist())
            places[new] = np.fromiter(map(self.known.__getitem__, different[new]), np.int64, len(new))
        self.met[places] += 1
        return places

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the stretches of all texts, and for each text where its own start."""
        marked = pc.binary_join_element_wise(MARK, pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        places = self._places(coded.dictionary.to_numpy(zero_copy_only=False))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return places[coded.indices.to_numpy()], bounds

    def encode(self, texts: pa.Array, ids_too: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Yields, for stretches of texts in order, the number of ids of each text and (ids_too) all their ids in a row."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = np.unique(np.searchsorted(ends, np.arange(AT_ONCE, int(ends[-1]) + AT_ONCE, AT_ONCE), side="left") + 1)
        first = 0
        for last in (*cuts[cuts < len(texts)].tolist(), len(texts)):
            yield self._encode(texts[first:last], ids_too)
            first = last

    def _encode(self, texts: pa.Array, ids_too: bool) -> tuple[np.ndarray, np.ndarray | None]:
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        counts, parts = np.zeros(len(texts), np.int64), {}
        if whole.any():
            at = np.flatnonzero(whole)
            for i, e in zip(at.tolist(), self.tokenizer.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.int32)
                counts[i] = len(e.ids)
        plain = np.flatnonzero(~whole)
        flat = np.empty(0, np.int32)
        if len(plain):
            places, bounds = self._cut(texts.take(pa.array(plain)) if whole.any() else texts)
            ends = np.concatenate(([0], np.cumsum(self.size[places], dtype=np.int64)))
            counts[plain] = np.diff(ends[bounds])
            if ids_too:
                flat = self._gathered(places)
        if not ids_too:
            return counts, None
        if not parts:
            return counts, flat
        starts = np.concatenate(([0], np.cumsum(counts[plain])))
        rank = np.cumsum(~whole) - 1
        pieces = [parts[i] if i in parts else flat[starts[rank[i]] : starts[rank[i] + 1]] for i in range(len(texts))]
        return counts, np.concatenate(pieces)
