"""Weighted terms of a posting and their presence in a text, for Arrow workers.

Sections need an ordered scan of lines and phrases are masked out longest first,
which no Column expression does; everything after that is DataFrame work.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import ahocorasick

from jobloom.functions import lexicon as words
from jobloom.functions.lexicon import Lexicon

SECTIONS = ("requirements", "duties", "nice")
_QUOTES = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
# Suffixes and what takes their place, the first that fits.
_SUFFIXES = [("ies", "y"), ("sses", "ss"), ("ing", ""), ("edly", ""), ("ed", ""), ("es", ""), ("s", "")]
# Small words that carry no meaning in a phrase.
_SMALL = frozenset("a an and of to for or the in on with as".split())


_dropped = re.compile(r"[^a-z0-9+#.'\-\s]").sub
_WORD = re.compile("[a-z0-9]+").fullmatch


def _plain_quotes(text: str) -> str:
    if not text.isascii():
        for a, b in _QUOTES.items():
            text = text.replace(a, b)
    return text


def normalise(text: str) -> str:
    low = text.lower()
    if _WORD(low):  # most terms are one such word
        return low
    return " ".join(_dropped(" ", _plain_quotes(low)).split())


def tokens(text: str) -> list[str]:
    return [t for raw in normalise(text).split() if (t := raw.strip(".'-"))]


def stem(word: str) -> str:
    if len(word) <= 3 or word[-1] not in "sgdy":  # no suffix ends otherwise
        return word
    fits = ((s, r) for s, r in _SUFFIXES if word.endswith(s) and len(word) - len(s) >= 3)
    suffix, instead = next(fits, ("", ""))
    if not suffix:
        return word
    base = word[: len(word) - len(suffix)] + instead
    doubled = suffix in ("ing", "ed") and len(base) >= 3 and base[-1] == base[-2] and base[-1] not in "lsz"
    return base[:-1] if doubled else base


def stem_key(word: str) -> str:
    return stem(word).rstrip("e") or word


def stemmed(text: str) -> str:
    return " ".join(map(stem_key, tokens(text)))


def variants(word: str) -> set[str]:
    bare = stem(word)
    forms = {word, bare, bare.rstrip("e") or word}
    for f in [f for f in forms if "-" in f] if "-" in word else ():
        forms |= {f.replace("-", ""), f.replace("-", " "), *f.split("-")}
    return forms - {""}


# Sections ------------------------------------------------------------------------------------


def heading_text(line: str) -> str:
    plain = _plain_quotes(line.strip().lower()).replace("-", " ")
    return " ".join(re.sub(r"[^a-z0-9' ]", "", plain).split())


def bucket(heading: str, opening: bool = False) -> str | None:
    """The section that a heading names; with ``opening`` the key must come first in it."""
    if opening and heading.startswith("why"):
        return "other"
    fits = heading.startswith if opening else heading.__contains__
    for name, keys in (("other", words.BENEFITS), ("requirements", words.REQUIREMENTS), ("duties", words.DUTIES), ("nice", words.NICE)):
        if any(map(fits, keys)):
            return name
    exact = {**dict.fromkeys(words.EXACT_DUTIES, "duties"), **dict.fromkeys(words.EXACT_REQUIREMENTS, "requirements")}
    return exact.get(heading)


def is_heading(line: str, alone: bool) -> bool:
    """Whether a line is a heading; ``alone``: blank lines around it."""
    bare = line.strip()
    if bare.startswith("#"):
        return True
    if len(bare) > 400 and bare.count(" ") > 60:  # far more than 14 words, whatever is taken out of them
        return False
    heading = heading_text(bare)
    n = len(heading.split())
    if not n:
        return False
    if n <= 6 and (bare.endswith(":") or (alone and any(map(str.isalpha, bare)) and all(c.isupper() for c in bare if c.isalpha()))):
        return True
    if "," in bare or bare.endswith((".", ";", ":")):
        return False
    parts = bare.split()
    if n <= 4:
        last_names_it = parts[-1][:1].isupper() and bucket(heading.split()[-1], opening=True) is not None
        first = next((p for p in parts if p[:1].isalpha()), "")
        if last_names_it or (alone and first[:1].isupper()):
            return True
    return n <= 14 and bucket(heading, opening=True) is not None


def sections(text: str) -> dict[str, str]:
    """Lines by section; a heading that names none leaves the section as it is."""
    out, now = defaultdict(list), "other"
    lines = text.splitlines()
    blank = [True, *(not x.strip() for x in lines), True]
    for i, line in enumerate(lines):
        if line.strip() and is_heading(line, blank[i] and blank[i + 2]):
            heading = heading_text(line)
            now = bucket(heading, opening=True) or bucket(heading) or now
        else:
            out[now].append(line)
    return {k: "\n".join(out[k]) for k in (*SECTIONS, "other")}


# Terms ---------------------------------------------------------------------------------------


_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Phrases:
    """Phrases of a vocabulary in texts: longest first, then in alphabetical order, each occurrence masked for the phrases behind it.

    One automaton finds the occurrences of all phrases and of their plurals in a
    pass over the text; only these are looked at in order, so a text's cost does
    not grow with the vocabulary.
    """

    def __init__(self, phrases: list[str]):
        self.phrases = sorted(phrases, key=lambda p: (-len(p), p))
        self.find = ahocorasick.Automaton()
        held: dict[str, list[int]] = defaultdict(list)
        for rank, p in enumerate(self.phrases):
            for form in ((p, p[:-1] + "ies") if p.endswith("y") else (p, p + "s")):
                held[form].append(rank)
        for form, ranks in held.items():
            self.find.add_word(form, (len(form), tuple(ranks)))
        self.find.make_automaton()

    def masked(self, text: str) -> tuple[str, list[tuple[str, int]]]:
        """The text with a blank for each occurrence, and how often each phrase occurs."""
        if not self.phrases or not text:
            return text, []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (size, ranks) in self.find.iter(text):
            for rank in ranks:
                places[rank].append((last + 1 - size, last + 1))
        if not places:
            return text, []
        gone, spans, out = bytearray(len(text) + 2), [], []  # gone[i + 1]: whether character i is masked
        edge = lambda i: not 0 <= i < len(text) or gone[i + 1] or text[i] not in _ALNUM
        for rank in sorted(places):
            own, end = [], 0
            for a, b in sorted(places[rank]):
                if a >= end and edge(a - 1) and edge(b) and not any(gone[a + 1 : b + 1]):
                    own.append((a, b))
                    end = b
            for a, b in own:
                gone[a + 1 : b + 1] = b"\1" * (b - a)
            if own:
                spans += own
                out.append((self.phrases[rank], len(own)))
        kept, at = [], 0
        for a, b in sorted(spans):
            kept += [text[at:a], " "]
            at = b
        return "".join([*kept, text[at:]]), out


class Extractor:
    """Term counts of texts under one vocabulary."""

    #: Words whose kind is kept; the frequent ones are among the first.
    MOST = 500_000

    def __init__(self, lexicon: Lexicon = Lexicon()):
        self.lexicon = lexicon
        self.phrases = Phrases([p for p in lexicon.skills if " " in p])
        self.kinds: dict[str, tuple[str, str, bool] | None] = {}

    def _kind(self, raw: str) -> tuple[str, str, bool] | None:
        """Word, term and whether it is a skill; None for words that are no terms."""
        word, out = raw.strip(".'-"), None
        if word and word not in self.lexicon.stop:
            if word in self.lexicon.skills:
                out = (word, self.lexicon.skills[word], True)
            elif word not in self.lexicon.boilerplate and (re.fullmatch("[a-z]{2,6}", word) or (len(word) >= 4 and re.search("[a-z]", word))):
                out = (word, word, False)
        if len(self.kinds) < self.MOST:
            self.kinds[raw] = out
        return out

    def counts(self, text: str, stop: frozenset[str] = frozenset(), flat: str | None = None) -> dict[str, dict]:
        """term -> {count, skill, capitalised, surfaces}; ``flat``: the normalised text, if it is known."""
        if not text:
            return {}
        skills = self.lexicon.skills
        named = {w.lower().strip(".'-") for w in re.findall(r"\b[A-Z][A-Za-z0-9+#.\-]*", text)}
        out: dict[str, dict] = {}

        def add(surface: str, term: str, skill: bool, capital: bool, n: int) -> None:
            t = out.get(term)
            if t is None:
                out[term] = {"count": n, "skill": skill, "capitalised": capital, "surfaces": {surface: n}}
                return
            t["count"] += n
            t["skill"] |= skill
            t["capitalised"] |= capital
            t["surfaces"][surface] = t["surfaces"].get(surface, 0) + n

        rest = normalise(text) if flat is None else flat
        rest, met = self.phrases.masked(rest)
        for phrase, n in met:
            add(phrase, skills[phrase], True, False, n)
        kinds = self.kinds
        for raw, n in Counter(rest.split()).items():  # each different word once
            kind = kinds[raw] if raw in kinds else self._kind(raw)
            if kind is None or kind[0] in stop:
                continue
            word, term, skill = kind
            if term in out:
                add(word, term, skill, word in named, n)
            else:
                out[term] = {"count": n, "skill": skill, "capitalised": word in named, "surfaces": {word: n}}
        return out

    def posting(self, text: str, title: str = "", stop: frozenset[str] = frozenset()) -> dict[str, dict]:
        """Terms of a posting with their counts by section and whether the title has them.

        A stop word counts again if requirements or duties name it and it is a skill.
        """
        parts = sections(text)
        flat = {k: normalise(parts[k]) for k in SECTIONS}
        if stop:
            wanted = {t for k in ("requirements", "duties") for raw in flat[k].split() if (t := raw.strip(".'-"))}
            stop = frozenset(s for s in stop if s not in wanted or s not in self.lexicon.skills)
        own = self.counts(text, stop)
        by = {s: self.counts(parts[s], stop, flat[s]) for s in SECTIONS}
        for s in ("nice", "duties"):  # terms that only a section on its own shows; those of requirements alone are left out
            for term, found in by[s].items():
                own.setdefault(term, found)
        in_title = self.counts(title, stop)
        for term, found in in_title.items():
            own.setdefault(term, found)
        for v in own.values():
            v["in_requirements"] = v["in_duties"] = v["in_nice"] = 0
            v["in_title"] = False
        for s in SECTIONS:
            for term, found in by[s].items():
                if term in own:
                    own[term][f"in_{s}"] = found["count"]
        for term in in_title:
            own[term]["in_title"] = True
        return own


# Presence ------------------------------------------------------------------------------------


class Present:
    """Whether terms occur in one text."""

    #: Answers that are kept.
    MOST = 500_000

    def __init__(self, text: str):
        found = tokens(text)
        self.forms = set().union(*map(variants, set(found))) if found else set()
        self.line = f" {' '.join(map(stem_key, found))} "
        self.known: dict[tuple[str, ...], bool] = {}

    def told(self, term: str, surfaces: list[str]) -> bool:
        """``has``, once for each different term and its surfaces."""
        key = (term, *surfaces)
        out = self.known.get(key)
        if out is None:
            out = self.has(term, surfaces)
            if len(self.known) < self.MOST:
                self.known[key] = out
        return out

    def _in_line(self, pattern: str) -> bool:
        return re.search(rf"(?<![a-z0-9]){pattern}(?![a-z0-9])", self.line) is not None

    def _compound(self, parts: list[str]) -> bool:
        own = {"-".join(parts), " ".join(parts), "".join(parts)}
        return bool(own & self.forms) or self._in_line("[- ]?".join(re.escape(stem_key(p)) for p in parts))

    def has(self, term: str, surfaces: list[str] | None = None) -> bool:
        for form in map(normalise, {term, *(surfaces or ())}):
            if _WORD(form):
                if not self.forms.isdisjoint(variants(form)):
                    return True
                continue
            parts = [p for p in form.split("-") if p]
            if " " in form:
                key = stemmed(form)
                if key and self._in_line(re.escape(key)):
                    return True
            elif len(parts) > 1:
                main = [p for p in parts if p not in _SMALL]
                if main and max(map(len, main)) >= 4 and (self._compound(parts) or self._compound(main)):
                    return True
            elif form and variants(form) & self.forms:
                return True
        return False


_NAMES = re.compile("[a-z0-9]+").findall


def noise_terms(company: str, recruiter: str = "") -> frozenset[str]:
    """Words of more than two letters of an employer's and a recruiter's name, and the employer's initials if they are two to four."""
    own = _NAMES((company or "").lower())
    initials = "".join([w[0] for w in own])
    every = own + _NAMES(recruiter.lower()) if recruiter else own
    return frozenset([w for w in every if len(w) > 2] + ([initials] if 2 <= len(initials) <= 4 else []))


def overlap(text: str, lines: list[str]) -> float:
    """Share of a text's longer words that the best single line has."""
    own = [w for w in map(stem_key, tokens(text)) if len(w) >= 4]
    sets = [set(map(stem_key, tokens(x))) for x in lines if x.strip()]
    return max((sum(w in s for w in own) for s in sets), default=0) / len(own) if own else 0.0


class Facts:
    """Which of many short texts have a term: an index from word forms to texts, checked text by text."""

    def __init__(self, texts: list[str]):
        self.looks = [Present(x) for x in texts]
        self.by_form: dict[str, set[int]] = defaultdict(set)
        self.by_stem: dict[str, set[int]] = defaultdict(set)
        for k, look in enumerate(self.looks):
            for form in look.forms:
                self.by_form[form].add(k)
            for word in look.line.split():
                for part in (word, *word.split("-")):
                    self.by_stem[part[:4]].add(k)

    def _may(self, form: str) -> set[int]:
        """Texts that could have one form of a term: none that has it is left out."""
        out = set().union(*(self.by_form.get(v, ()) for v in variants(form)), set()) if " " not in form else set()
        words = [w for part in form.split() for w in part.split("-") if w]
        if len(words) > 1:  # a phrase or a compound: texts with a word that starts like its longest one, or runs its parts together
            keys = {stem_key(max(words, key=len))[:4], stem_key("".join(words))[:4], stem_key(words[0])[:4]}
            out |= set().union(*(self.by_stem.get(k, ()) for k in keys))
            out |= set().union(*(self.by_form.get(x, ()) for x in ("-".join(words), " ".join(words), "".join(words))))
        return out

    def having(self, term: str, surfaces: list[str]) -> list[int]:
        found = set().union(*(self._may(f) for f in map(normalise, {term, *surfaces})))
        return sorted(k for k in found if self.looks[k].has(term, surfaces))
