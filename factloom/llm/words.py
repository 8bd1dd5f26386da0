"""The tokenizers library, one white-space segment at a time with a memo.

The vocabulary's normaliser and splitter act within runs of other characters,
so the ids of a text are those of its segments between spaces in turn, if no
added token holds a space and normalisation and splitting drop white space.
The loaded file is asked for that; otherwise whole texts are encoded. A new
segment of Latin letters and closing punctuation is made of pre-tokens that the
splitter keeps apart anyway; the library gets the distinct ones many to a call,
and its marks of word ends part them again.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: A generation of the memo holds so many segments; so many new ones are encoded in a call.
MEMO, CALL = 400_000, 20_000
#: Letters that composition leaves alone and lower-casing maps one to one.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch
CLOSING = ".,;:!?"
#: A text or line of only these is lower-cased as a whole; its pre-tokens are its words, points and commas.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ \\n\\t.,]*").fullmatch
#: So many pre-tokens make one text for the library.
JOINED = 128


def words_only(text: str) -> bool:
    return bool(PLAIN(text)) and not (".." in text or ",," in text or ".," in text or ",." in text)


def words_and_marks(text: str) -> list[str]:
    return text.lower().replace(".", " . ").replace(",", " , ").split()


class Words:
    def __init__(self, path: str, special: bool = True):
        """special: whether special tokens' strings in a text become their ids, the library's default."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        with open(path) as f:
            spec = json.load(f)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        steps = spec["pre_tokenizer"].get("pretokenizers", []) if spec.get("pre_tokenizer") else []
        first = steps[0] if steps else {}
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        plain = not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
        kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        added_space = bool(len(steps) > 1 and steps[1].get("add_prefix_space"))
        self.by_segment = drops and plain and kinds <= {"NFC", "Replace", "Lowercase"} and not added_space
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        end = spec["model"].get("end_of_word_suffix")
        pattern = first.get("pattern", {}).get("Regex", "")
        self.by_word = self.by_segment and bool(end) and pattern.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        self.ends = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = bool(end) and token.endswith(end)

    def pre_tokens(self, segment: str) -> list[str] | None:
        """Those of a segment of Latin words and closing punctuation, in lower case; None for any other."""
        found = []
        for line in segment.split("\n"):
            word = line.rstrip(CLOSING)
            if word:
                if not word.isalpha() or not (word.isascii() or LATIN(word)):
                    return None
                found.append(word.lower())
            if len(word) < len(line):
                found.append(line[len(word) :])
        return found

    def split(self, text: str) -> list[str]:
        """Pieces of the text whose ids don't depend on their neighbours."""
        if not self.by_word:
            return text.split(" ")
        if words_only(text):
            return words_and_marks(text)
        found: list[str] = []
        for line in text.split("\n"):
            found += words_and_marks(line) if words_only(line) else line.split(" ")
        return found

    def learn(self, new: list[str]) -> None:
        """Put new segments into the memo."""
        if self.by_word:
            # a lower-case word is its own pre-token
            whole = [s for s in new if s.isalpha() and s.islower() and (s.isascii() or LATIN(s))]
            held = set(whole)
            new = [s for s in new if s not in held]
            split = [self.pre_tokens(s) for s in new]
            distinct = [*whole, *({p for s in split if s for p in s} - held)]
            known: dict[str, bytes] = {}
            joined = [" ".join(distinct[k : k + JOINED]) for k in range(0, len(distinct), JOINED)]
            for k, e in enumerate(self.library.encode_batch_fast(joined, add_special_tokens=False)):
                part = distinct[k * JOINED : (k + 1) * JOINED]
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(part):
                    raise ValueError("the library splits these words in another way")
                raw, at = ids.tobytes(), 0
                for p, cut in zip(part, (cuts * 4).tolist(), strict=True):
                    known[p] = raw[at:cut]
                    at = cut
            self.memo.update((s, known[s]) for s in whole)
            for s, found in zip(new, split, strict=True):
                if found is not None:
                    self.memo[s] = b"".join([known[p] for p in found])
            new = [s for s, found in zip(new, split, strict=True) if found is None]
        for k in range(0, len(new), CALL):
            part = new[k : k + CALL]
            for s, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[s] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        if not self.by_segment:
            return [np.array(e.ids, "<u4") for e in self.library.encode_batch(texts, add_special_tokens=False)]
        split = [self.split(t) for t in texts]
        if len(self.memo) > MEMO:  # a segment that comes again is carried over from the last generation
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = set().union(*split).difference(memo)
        again = [s for s in new if s in older]  # set.intersection would go through all of older
        if again:
            memo.update(zip(again, map(older.__getitem__, again), strict=True))
            new.difference_update(again)
        self.learn(list(new))
        return [np.frombuffer(b"".join(map(memo.__getitem__, s)), "<u4") for s in split]


LOADED: dict[tuple[str, bool], Words] = {}


def words(path: str, special: bool = True) -> Words:
    """One for each Python worker."""
    if (path, special) not in LOADED:
        LOADED[path, special] = Words(path, special)
    return LOADED[path, special]
