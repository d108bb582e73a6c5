"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memory of words already encoded.

Both vocabularies used here split a text into pieces before any merge, and a piece never crosses the single space
between two words, nor goes from a letter into the punctuation that ends a word. So a text's ids are the joined ids of its
words, and words met before need no second encoding. Arrow splits a stretch of texts into words and closing marks and
names the distinct ones; only those are looked up, and the ids of all words are then gathered at once.

Texts whose white space is irregular (runs, tabs, exotic blanks) or that spell one of the vocabulary's special tokens are
encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in a worker's memory; beyond it only those met in several stretches of texts stay, half of it at most.
CACHE_WORDS = 300_000
#: Longer words are encoded anew each time, so that the memory is bounded in bytes too.
WORD_CHARS = 64
#: White space other than a single space or a single line feed between two words.
_ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n"
#: Marks a text's first word, which has no space before it; regular texts hold no carriage return.
_FIRST = "\r"
_MARK = "|"
#: A Latin letter and the marks that end its word. The marks are set apart, after a tab, which regular texts don't hold either.
#: U+0130 is left out: its small form ends in a combining dot, which belongs to the marks.
_CLOSING, _APART = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([.,;:!?$%&*#]+)( |\n|$)", "\\1 \t\\2\\3"
#: Runs of letters that need no splitting, in either case or in lower case only.
_LETTERS, _SMALL = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"), re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Words on which a direct call of the merge model must agree with the whole tokenizer before it is used.
_PROBES = ["a", "the", "network", "straßen", "élève", "zürich", "ñandú", "unforgettableness", "àéîÿ", "thntondersh"]
_encoders: dict[str, WordEncoder] = {}


def _letters_of_bytes() -> list[str]:
    """The published byte alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_BYTE_LETTER = _letters_of_bytes()


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ids[start : start + size], one after the other."""
    ends = np.cumsum(size)
    return ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)]


class WordEncoder:
    """``encode(texts)`` gives the ids of all texts in one array, and where each text ends."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.odd = "|".join([_ODD, *(f"(?i:{re.escape(t.content)})" for t in added if t.content)])
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            self.odd = "(?s)."  # such tokens may match more than their own letters: every text is encoded whole
        mark = self._whole([" " + _MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.model = self.tokenizer.model
        self.one_case = self._same([" AbC"], [" abc"])
        self.letters = _SMALL if self.one_case else _LETTERS
        probes = _PROBES if self.one_case else _PROBES + [p.upper() for p in _PROBES if p.upper().lower() == p]
        whole = self._whole([" " + p for p in probes])
        self.lead = next((x for x in (_BYTE_LETTER[32], "") if all(w.tolist() == list(self._direct(p, x)) for p, w in zip(probes, whole))), None)
        self.numbers: dict[str, int] = {}
        self.start, self.size, self.seen, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Keep the words met most often, and only those met more than once; older meetings count half from then on."""
        often = np.argsort(-self.seen, kind="stable")[: self.limit // 2]
        keep = np.sort(often[self.seen[often] > 1])
        words = list(self.numbers)
        self.numbers = {words[k]: n for n, k in enumerate(keep.tolist())}
        self.ids = gather(self.ids, self.start[keep], self.size[keep])
        self.size, self.seen = self.size[keep], self.seen[keep] // 2
        self.start = np.cumsum(self.size) - self.size

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _same(self, a: list[str], b: list[str]) -> bool:
        return [x.tolist() for x in self._whole(a)] == [x.tolist() for x in self._whole(b)]

    def _direct(self, letters: str, lead: str) -> array:
        """A run of letters needs no splitting: the merge model alone gives its ids."""
        spelled = letters if letters.isascii() else "".join([_BYTE_LETTER[b] for b in letters.encode()])
        return array("I", [t.id for t in self.model.tokenize(lead + spelled)])

    def _encode_items(self, items: list[str]) -> list[np.ndarray | array]:
        """Ids of words, each with what stands before it: a space, a line feed or nothing."""
        run = self.letters.fullmatch
        found = [self._direct(x, self.lead) if self.lead is not None and run(x) else None for x in items]
        spelled = [x[1:] if x[:1] in (_FIRST, "\t") else x if x[:1] == "\n" else " " + x for x in items]
        if self.mark is not None:  # many words in one call: a marker word shows where each one ends
            plain = [k for k, x in enumerate(items) if found[k] is None and x and x[0] not in _FIRST + "\t" and _MARK not in x]
            for i in range(0, len(plain), 20_000):
                part = plain[i : i + 20_000]
                ids = np.array(self.tokenizer.encode_batch_fast(["".join([f"{spelled[k]} {_MARK}" for k in part])], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(ids == self.mark)
                if len(ends) == len(part):
                    for k, a, z in zip(part, [0, *(ends[:-1] + 1).tolist()], ends.tolist()):
                        found[k] = ids[a:z]
        rest = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(rest, self._whole([spelled[k] for k in rest])):
            found[k] = ids
        return found

    def _numbers(self, items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each item, start, size, ids); the tables hold the remembered words and the new ones."""
        known = list(map(self.numbers.get, items))
        new = [k for k, x in enumerate(known) if x is None]
        if not new:
            self.seen[known] += 1
            return np.array(known, np.int64), self.start, self.size, self.ids
        base = len(self.numbers)
        order = sorted(new, key=lambda k: len(items[k]) > WORD_CHARS)  # those to be remembered first
        for n, k in enumerate(order, base):
            known[k] = n
        fresh = self._encode_items([items[k] for k in order])
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        size = np.concatenate([self.size, lengths])
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
        ids = np.concatenate([self.ids, np.frombuffer(b"".join([x.tobytes() for x in fresh]), np.uint32)])
        short = sum(len(items[k]) <= WORD_CHARS for k in order)
        self.numbers.update(zip([items[k] for k in order[:short]], range(base, base + short)))
        stop = base + short
        self.start, self.size, self.ids = start[:stop], size[:stop], ids[: int(start[stop - 1] + size[stop - 1]) if stop else 0]
        numbers = np.array(known, np.int64)
        self.seen = np.concatenate([self.seen, np.zeros(short, np.int64)])
        self.seen[numbers[numbers < stop]] += 1
        return numbers, start, size, ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts (no nulls) and each text's end among them."""
        if len(self.numbers) > self.limit:
            self.forget()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, self.odd)
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", texts) if len(odd_rows) else texts
        plain = pc.replace_substring_regex(pc.ascii_lower(plain) if self.one_case else plain, _CLOSING, _APART)
        items = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_FIRST, plain, ""), "\n", " \n"), " ")
        words = items.flatten().dictionary_encode()
        number, start, size, table = self._numbers(words.dictionary.to_pylist())
        which = number[words.indices.to_numpy()]
        ids = gather(table, start[which], size[which])
        stops = np.cumsum(size[which])[np.cumsum(pc.list_value_length(items).to_numpy()) - 1]
        if len(odd_rows):
            whole = dict(zip(odd_rows.tolist(), self._whole(texts.take(pa.array(odd_rows)).to_pylist())))
            parts = [whole.get(k, ids[a:z]) for k, (a, z) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist()))]
            ids, stops = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, stops
