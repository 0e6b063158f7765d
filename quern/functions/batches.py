"""The text functions for whole batches, where a task needs the tokens themselves."""

from __future__ import annotations

import re
import unicodedata

from quern.functions.text import TOKEN, _suffixes
from quern.profile import MACEDONIAN, Profile

#: Stems that a worker keeps.
_KEPT = 1 << 17


class Terms:
    """What tokens() gives for a text: the same patterns, each word stemmed once."""

    def __init__(self, profile: Profile = MACEDONIAN, do_stem: bool = True):
        self.stop, self.stems, self.do_stem = frozenset(profile.stopwords), {}, do_stem
        self.last = frozenset(s[-1] for s, _ in (*profile.derivational, *profile.inflectional))
        self.rules = [(re.compile(pattern), left.replace("$", "\\")) for pattern, left in (_suffixes(profile.derivational), _suffixes(profile.inflectional))]
        self.find = re.compile(TOKEN).findall

    def stem(self, word: str) -> str:
        if word[-1] in self.last:
            for pattern, left in self.rules:
                word = pattern.sub(left, word)
        return word

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text if text.isascii() else unicodedata.normalize("NFKC", text)
        words, stop = self.find(text.lower()), self.stop
        if not self.do_stem:
            return [w for w in words if w not in stop]
        stems, out = self.stems, []
        for w in words:
            s = stems.get(w)
            if s is None:
                if len(stems) > _KEPT:
                    stems.clear()
                s = stems[w] = "" if w in stop else self.stem(w)  # no stem is empty
            if s:
                out.append(s)
        return out

