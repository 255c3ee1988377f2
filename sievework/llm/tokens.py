"""Token ids by the tokenizers library, with each word of a batch encoded once.

A tokenizer whose normalizer, splitter and model treat white space as a mere border gives a text's ids as
its words' ids one after the other. For such a one, the distinct words of a batch are taken apart into
letters and closing marks; parts that are not in a bounded table go to the tokenizer's model in one call,
whose ids are cut where a token ends a word; anything unusual goes to the whole tokenizer. Other
tokenizers encode whole texts.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from . import shared

DEFAULT = "word_bpe_49k.json"
#: Marks that may close a plain word.
ENDS = ".,;:!?"
#: Letters below U+0180 begin with a byte under this one.
PLAIN_LEAD = 0xC6
#: Parts of words remembered by a worker before the table starts anew.
TABLE_PARTS = 300_000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


def _byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: itself if printable, else the next unused code."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _sizes(col: pa.Array) -> np.ndarray:
    return pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)


def _pick(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + sizes[0]] and so on, one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class _Table:
    """Runs of ids, by number."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes) - sizes


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        suffix = spec.get("model", {}).get("end_of_word_suffix")
        self.by_word = (
            norm == ["NFC", "Replace", "Lowercase"]
            and pre[0].get("pattern", {}).get("Regex") == _PATTERN
            and pre[0].get("behavior") == "Removed"
            and pre[0].get("invert") is True
            and pre[-1].get("type") == "ByteLevel"
            and not pre[-1].get("add_prefix_space")
            and spec.get("post_processor") is None
            and bool(suffix)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        )
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        if self.by_word:
            self.model = Tokenizer(self.whole.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.closes = np.zeros(self.whole.get_vocab_size(), bool)
            self.closes[[i for t, i in self.whole.get_vocab().items() if t.endswith(suffix)]] = True
            self.letters = np.array([ord(c) for c in _byte_letters()], "<u4")
            self.letters[0x20] = 0x20
            self.known: dict[str, int] = {}
            self.table, self.uses = _Table(np.zeros(0, np.uint32), np.zeros(0, np.int64)), np.zeros(0, np.int64)

    def _model(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for distinct parts, each letters or marks only, in one call of the tokenizer's model."""
        data = np.frombuffer(" ".join(parts).encode(), np.uint8)
        ids = np.array(self.model.encode_batch_fast([self.letters[data].tobytes().decode("utf-32-le")])[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            raise ValueError("the tokenizer's tokens do not tell where words end")
        return ids, np.diff(ends, prepend=0)

    def _parts(self, parts: pa.Array) -> np.ndarray:
        """Numbers in the table of parts; a full table starts anew with the parts that were met more than once."""
        if len(self.known) > TABLE_PARTS:
            often = np.flatnonzero(self.uses[: len(self.known)] > 1)
            often = often[: TABLE_PARTS // 2]
            names = list(self.known)
            self.known = {names[i]: k for k, i in enumerate(often.tolist())}
            self.table = _Table(_pick(self.table.flat, self.table.starts[often], self.table.sizes[often]), self.table.sizes[often])
            self.uses = np.zeros(len(often), np.int64)
        names = parts.to_pylist()
        codes = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            ids, sizes = self._model(new)
            codes[missing] = len(self.known) + np.arange(len(new))
            self.known.update(zip(new, codes[missing].tolist()))
            self.table = _Table(np.concatenate([self.table.flat, ids]), np.concatenate([self.table.sizes, sizes]))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[codes] += 1
        return codes

    def _words(self, words: pa.Array) -> _Table:
        """Ids of distinct words.

        A plain word is letters below U+0180, then any of ENDS. Such letters are their own NFC form and
        are lower-cased one by one, and the two parts are what the splitter makes of the word. Others go
        to the whole tokenizer.
        """
        stems = pc.utf8_rtrim(words, ENDS)
        data, offs = shared.utf8_view(stems)
        high = np.concatenate([[0], np.cumsum(data >= PLAIN_LEAD)])
        plain = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & (high[offs[1:]] == high[offs[:-1]])
        plain &= ~pc.match_substring(stems, "\u0130").to_numpy(zero_copy_only=False)
        cut, size = _sizes(stems), _sizes(words)
        at, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        marked = np.flatnonzero(plain & (size > cut))
        low = pc.utf8_lower(stems.take(pa.array(at))).dictionary_encode()
        marks = pa.array([w[n:] for w, n in zip(words.take(pa.array(marked)).to_pylist(), (cut - size)[marked].tolist())], pa.string()).dictionary_encode()  # ENDS are a byte each
        codes = self._parts(pa.concat_arrays([low.dictionary, marks.dictionary]))
        rest = self.whole.encode_batch_fast(words.take(pa.array(odd)).to_pylist(), add_special_tokens=False) if len(odd) else []
        rest_sizes = np.fromiter((len(e.ids) for e in rest), np.int64, len(odd))
        known = len(self.table.sizes)
        flat = np.concatenate([self.table.flat, np.fromiter(chain.from_iterable(e.ids for e in rest), np.uint32, int(rest_sizes.sum()))])
        runs = _Table(flat, np.concatenate([self.table.sizes, rest_sizes, [0]]))
        # two runs a word: letters and marks, or the word and nothing, which is the last run
        pair = np.full((len(words), 2), len(runs.sizes) - 1, np.int64)
        pair[at, 0] = codes[low.indices.to_numpy()]
        pair[marked, 1] = codes[len(low.dictionary) + marks.indices.to_numpy()]
        pair[odd, 0] = known + np.arange(len(odd))
        sizes = runs.sizes[pair]
        return _Table(_pick(runs.flat, runs.starts[pair].ravel(), sizes.ravel()), sizes.sum(1))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the id end after each, and the texts' bounds in them."""
        bounds = np.zeros(len(texts) + 1, np.int64)
        if not self.by_word:
            found = [e.ids for e in self.whole.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            np.cumsum([len(x) + 1 for x in found], out=bounds[1:])
            return np.fromiter((t for x in found for t in (*x, end)), np.uint32, int(bounds[-1])), bounds
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        words = split.flatten().dictionary_encode()
        table = self._words(words.dictionary)
        codes = words.indices.to_numpy()
        sizes = table.sizes[codes]
        total = np.concatenate([[0], np.cumsum(sizes)])
        last = np.cumsum(split.value_lengths().to_numpy())
        bounds[1:] = total[last] + np.arange(1, len(texts) + 1)
        out = np.empty(bounds[-1], np.uint32)
        body = np.ones(len(out), bool)
        body[bounds[1:] - 1] = False
        out[~body] = end
        out[body] = _pick(table.flat, table.starts[codes], sizes)
        return out, bounds


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path)
