"""Text analysis: the same analyzers as Spark columns over tables and as Python over the words of a query.

An analysed text is an array of terms by position; a removed stop word leaves a
NULL, so that phrases keep their gaps.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import IllegalArgument, Unsupported
from quarry.functions.stemmers import french_light, porter

#: Ideographs and kana that stand for themselves: each is a word.
_ALONE = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3041-\u309f"
_RUN = rf"(?:[^\P{{L}}{_ALONE}]+\p{{M}}*)+"
#: Word bounds without look-around, alike in Java and RE2; terms need a letter or digit.
WORD = rf"[{_ALONE}]\p{{M}}*|(?:{_RUN}(?:[.:'’·]{_RUN})*|\p{{N}}+(?:[.,;'’]\p{{N}}+)*|_)+"
LETTERS = r"\p{L}+"
#: Terms of this many bytes and more are dropped.
LIMIT = 255

ENGLISH_STOPS = frozenset("a an as at be by if in is it no of on or to / and are but for not the was / into such that then they this will with / their there these".replace("/", " ").split())
_FRENCH_STEMS = {
    "": "ai au aux avec c ce ceci cela ces cet cette d dans de des du elle en es et eu eux ici il ils j je l la le les leur leurs lui m ma mais me mes moi mon même n ne nos notre nous on ont ou par pas pour qu que qui s sa sans se ses soi sont suis sur t ta te tes toi ton tu un une vos votre vous y à",
    "ai": "e ent es t", "aur": "ai aient ais ait ez iez ions ons ont", "av": "aient ais ait ez iez ons", "ay": "ant ez ons", "e": "ue ues urent us usse ussent usses ussiez ussions ut ûmes ût ûtes",
    "f": "urent us usse ussent usses ussiez ussions ut ûmes ûtes", "quel": "le les s", "ser": "a ai aient ais ait as ez iez ions ons ont", "soi": "ent s t", "soy": "ez ons", "ét": "aient ais ait ant iez ions ée ées", "ê": "tes",
}
FRENCH_STOPS = frozenset(stem + end for stem, ends in _FRENCH_STEMS.items() for end in ends.split()) | {"quel"}
ELIDED = ("c", "d", "j", "jusqu", "l", "lorsqu", "m", "n", "puisqu", "qu", "quoiqu", "s", "t")

_ELISION = "(?i)^(?:" + "|".join(sorted(ELIDED, key=len, reverse=True)) + ")['’]"
_POSSESSIVE = "(?<=.)['’＇][sS]$"
_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "ł": "l", "Ł": "L"}


def _folding() -> tuple[str, str]:
    """Accented letters and their plain ones."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFD", chr(code))[0]
        if plain.isascii() and plain.isalpha():
            found[chr(code)] = plain
    found |= {k: v for k, v in _LIGATURES.items() if len(v) == 1}
    return "".join(found), "".join(found.values())


_ACCENTED, _ASCII = _folding()
_FOLD = str.maketrans(_ACCENTED, _ASCII) | {ord(k): v for k, v in _LIGATURES.items() if len(v) > 1}


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer, the filters applied in turn, and the stop words that the filter `stop` removes."""

    name: str
    tokenizer: str
    filters: tuple[str, ...] = ()
    stops: frozenset[str] = frozenset()
    stemmer: str | None = None

    # -- one text, in Python -------------------------------------------------

    def offsets(self, text: str) -> list[tuple[str | None, int, int]]:
        """(term or None, start, end) by position."""
        if self.tokenizer == "keyword":
            found = [(text, 0, len(text))]
        else:
            pattern = {"standard": WORD, "letter": LETTERS, "whitespace": r"\S+"}[self.tokenizer]
            found = [(m.group(), m.start(), m.end()) for m in regex.finditer(pattern, text)]
            if self.tokenizer == "standard":
                found = [x for x in found if regex.search(r"[\p{L}\p{N}]", x[0])]
            found = [x for x in found if len(x[0].encode()) < LIMIT]
        return [(self._filtered(term), a, b) for term, a, b in found]

    def terms(self, text: str) -> list[str | None]:
        return [t for t, _, _ in self.offsets(text)]

    def _filtered(self, term: str) -> str | None:
        for f in self.filters:
            if f == "lowercase":
                term = term.lower()
            elif f == "asciifolding":
                term = term.translate(_FOLD)
            elif f == "elision":
                term = regex.sub(_ELISION, "", term)
            elif f == "possessive":
                term = regex.sub(_POSSESSIVE, "", term) if len(term) > 2 else term
            elif f == "stop" and term in self.stops:
                return None
        return _stem(self.stemmer, term)

    # -- a column ------------------------------------------------------------

    def column(self, text: Column) -> Column:
        """Terms of a string column; NULL for NULL."""
        terms = self.unstemmed(text)
        return _stem_udf(self.stemmer)(terms) if self.stemmer else terms

    def stem(self, term: Column) -> Column:
        """The stem of a single term, as `unstemmed` has them."""
        return F.get(_stem_udf(self.stemmer)(F.array(term)), F.lit(0)) if self.stemmer else term

    def unstemmed(self, text: Column) -> Column:
        """As `column`, before stemming."""
        if self.tokenizer == "keyword":
            terms = F.when(text.isNotNull(), F.array(text))
        else:
            pattern = {"standard": WORD, "letter": LETTERS, "whitespace": r"\S+"}[self.tokenizer]
            terms = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            if self.tokenizer == "standard":
                terms = F.filter(terms, lambda t: (F.octet_length(t) < LIMIT) & t.rlike(r"[\p{L}\p{N}]"))
            else:
                terms = F.filter(terms, lambda t: F.octet_length(t) < LIMIT)
        for f in self.filters:
            if f == "lowercase":
                terms = F.transform(terms, F.lower)
            elif f == "asciifolding":
                terms = F.transform(terms, _fold_column)
            elif f == "elision":
                terms = F.transform(terms, lambda t: F.regexp_replace(t, _ELISION, ""))
            elif f == "possessive":
                terms = F.transform(terms, lambda t: F.when(F.length(t) > 2, F.regexp_replace(t, _POSSESSIVE, "")).otherwise(t))
            elif f == "stop":
                stops = sorted(self.stops)
                terms = F.transform(terms, lambda t: F.when(~t.isin(stops), t))
        return terms


def _fold_column(t: Column) -> Column:
    for k, v in _LIGATURES.items():
        if len(v) > 1:
            t = F.replace(t, F.lit(k), F.lit(v))
    return F.translate(t, _ACCENTED, _ASCII)


def _stem(kind: str | None, term: str) -> str:
    return porter(term) if kind == "porter" else french_light(term) if kind == "french" else term


def _stem_udf(kind: str):
    @F.arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()  # every distinct term of the batch is stemmed once, and no other becomes a Python object
        stemmed = pa.array([_stem(kind, t) for t in words.dictionary.to_pylist()], pa.string())
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), stemmed.take(words.indices), mask=lists.is_null())

    return stems


BUILT_IN = {
    a.name: a
    for a in (
        Analyzer("standard", "standard", ("lowercase",)),
        Analyzer("simple", "letter", ("lowercase",)),
        Analyzer("whitespace", "whitespace"),
        Analyzer("keyword", "keyword"),
        Analyzer("stop", "letter", ("lowercase", "stop"), ENGLISH_STOPS),
        Analyzer("english", "standard", ("possessive", "lowercase", "stop"), ENGLISH_STOPS, "porter"),
        Analyzer("french", "standard", ("elision", "lowercase", "stop"), FRENCH_STOPS, "french"),
    )
}
_STOP_SETS = {"_english_": ENGLISH_STOPS, "_french_": FRENCH_STOPS, "_none_": frozenset()}


def _custom_filters(name: str, wanted, own: dict) -> tuple[list[str], frozenset[str]]:
    filters, stops = [], frozenset()
    for f in [wanted] if isinstance(wanted, str) else wanted or []:
        spec = own.get(f, {"type": f})
        kind = spec.get("type")
        if kind not in ("lowercase", "asciifolding", "stop"):
            raise Unsupported(f"token filter [{f}] of analyzer [{name}] is not supported")
        for key in spec:
            if key not in ("type", "stopwords"):
                raise Unsupported(f"[{key}] of token filter [{f}] is not supported")
        if kind == "stop":
            words = spec.get("stopwords", "_english_")
            if isinstance(words, str) and words.startswith("_"):
                if words not in _STOP_SETS:
                    raise Unsupported(f"stop words [{words}] are not supported")
                stops |= _STOP_SETS[words]
            else:
                stops |= frozenset([words] if isinstance(words, str) else words)
        filters.append(kind)
    return filters, stops


def custom(analysis: dict | None) -> dict[str, Analyzer]:
    """The built-in analyzers and those that an index's settings define."""
    out = dict(BUILT_IN)
    analysis = analysis or {}
    for section in analysis:
        if section not in ("analyzer", "filter"):
            raise Unsupported(f"[analysis.{section}] is not supported")
    for name, spec in analysis.get("analyzer", {}).items():
        kind = spec.get("type", "custom")
        if kind != "custom":
            if kind not in BUILT_IN or set(spec) - {"type", "stopwords"}:
                raise Unsupported(f"analyzer type [{kind}] is not supported")
            base = BUILT_IN[kind]
            _, stops = _custom_filters(name, ["stop"], {"stop": {"type": "stop", "stopwords": spec["stopwords"]}}) if "stopwords" in spec else (None, base.stops)
            out[name] = Analyzer(name, base.tokenizer, base.filters, stops, base.stemmer)
            continue
        for key in spec:
            if key not in ("type", "tokenizer", "filter"):
                raise Unsupported(f"[{key}] of analyzer [{name}] is not supported")
        tokenizer = spec.get("tokenizer")
        if tokenizer not in ("standard", "whitespace", "keyword", "letter", "lowercase"):
            raise Unsupported(f"tokenizer [{tokenizer}] of analyzer [{name}] is not supported")
        filters, stops = _custom_filters(name, spec.get("filter"), analysis.get("filter", {}))
        if tokenizer == "lowercase":
            tokenizer, filters = "letter", ["lowercase", *filters]
        out[name] = Analyzer(name, tokenizer, tuple(filters), stops)
    return out


def analyze(analyzer: Analyzer, texts: str | list[str]) -> list[dict]:
    """Tokens with offsets and positions; several texts have running offsets, each its own positions."""
    if not isinstance(texts, (str, list)):
        raise IllegalArgument("[text] must be a string or a list of strings")
    out, base = [], 0
    for text in [texts] if isinstance(texts, str) else texts:
        for i, (term, a, b) in enumerate(analyzer.offsets(text)):
            if term is not None:
                out.append({"token": term, "start_offset": base + a, "end_offset": base + b, "type": "<ALPHANUM>", "position": i})
        base += len(text)
    return out


def neighbours(terms: list[str | None]) -> list[tuple[int, str]]:
    """(position, term) of the terms that weren't removed, from the first one's position."""
    kept = [(i, t) for i, t in enumerate(terms) if t is not None]
    return [(i - kept[0][0], t) for i, t in kept]
