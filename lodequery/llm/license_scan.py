"""License scans by template-markup matching.

A template is a line of words in which ``[[...]]`` marks a region that may be
absent and ``{{n}}`` or ``{{m,n}}`` a region that ``m`` (or no) to ``n`` words of
any kind fill. :func:`from_markup` makes one of a whole licence text in the markup
that lists of licences publish: ``<<beginOptional>>``, ``<<endOptional>>`` and
``<<var;name=..;original=..;match=..>>``, whose ``.{m,n}`` counts words here and
whose ``.*`` and ``.+`` have ``VAR_WORDS`` at most, so that automata are finite.
Templates are compiled into token automata; a text has a template's label where
some run of its words is accepted, so all wording outside the marked regions has
to match word for word.

Nulls and texts without a word have no label, a score of 0 and null places; very
long texts are scanned whole, one text at a time; repeated rows give equal rows;
an empty table gives an empty result; other columns of the input are left out.
Of several runs of a template from one place the longest counts; equal labels are
named once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import MARKUP

# Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Templates of the method's own labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[version]] 2 0",
    "mit": "under the [[terms of the]] mit license",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation {{3}}]] version 3",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation {{3}}]] version 2",
    "bsd": "under the [[terms of the]] [[{{1}} clause]] bsd license",
    "mpl-2.0": "subject to the terms of the mozilla public license [[v]] [[version]] 2 0",
    "cc-by-nc": "cc by nc [[sa]] [[nd]] {{2}}",
    "cc-by-sa": "cc by sa {{2}}",
    "cc-licence": "licensed under [[a]] [[the]] creative commons attribution [[noncommercial]] [[sharealike]] {{2}} [[international]] license",
    "copyright-notice": "copyright [[c]] {{4}} all rights reserved",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this [[{{3}}]] software and associated documentation files",
}

VAR_WORDS = 20  # of a replaceable region without a bound of its own

OUTPUT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long>>"
)

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


_TOKEN = re.compile(r"\[\[|\]\]|\{\{\d+(?:,\d+)?\}\}|[^\s\[\]{}]+")
_TAG = re.compile(r"<<(.*?)>>", re.S)


def from_markup(markup: str) -> str:
    """The template of a licence text whose optional and replaceable regions are in tags."""
    out = []
    for i, part in enumerate(_TAG.split(markup)):
        kind = part.split(";")[0].strip() if i % 2 else ""
        if i % 2 == 0:
            out += [w.decode() for w in words_of(part)]
        elif kind == "beginOptional":
            out.append("[[")
        elif kind == "endOptional":
            out.append("]]")
        elif kind == "var":
            match = re.search(r'match="(.*?)"', part, re.S)
            bounds = re.fullmatch(r"\.\{(\d+),(\d+)\}", match[1]) if match else None
            least, most = (int(bounds[1]), int(bounds[2])) if bounds else (int(bool(match) and match[1] == ".+"), VAR_WORDS)
            out.append(f"{{{{{least},{most}}}}}")
        else:
            raise ValueError(f"an unknown tag: {part}")
    return " ".join(out)


def _bounds(token: str) -> tuple[int, int]:
    """The least and the largest number of words of a replaceable region."""
    numbers = [int(x) for x in token[2:-2].split(",")]
    return (numbers[0] if len(numbers) == 2 else 0), numbers[-1]


@dataclass
class Automaton:
    """Token automaton of one template; ``on[s]`` maps a word, or None for any word, to the next state."""

    label: str
    mandatory: frozenset[bytes]
    on: list[dict[bytes | None, int]] = field(default_factory=list)
    skips: list[set[int]] = field(default_factory=list)
    final: int = 0

    def _state(self) -> int:
        self.on.append({})
        self.skips.append(set())
        return len(self.on) - 1

    def closed(self, states: Iterable[int]) -> set[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.skips[s]
        return seen

    def firsts(self) -> set[bytes]:
        return {w for s in self.closed([0]) for w in self.on[s] if w is not None}

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run that starts at ``start``."""
        states, end, i = self.closed([0]), None, start
        while states:
            if self.final in states:
                end = i
            if i == len(words):
                break
            step = set()
            for s in states:
                on = self.on[s]
                if words[i] in on:
                    step.add(on[words[i]])
                if None in on:
                    step.add(on[None])
            states, i = self.closed(step), i + 1
        return end


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template. It has to begin with a word outside any marked region."""
    tokens = _TOKEN.findall(template)
    depth, mandatory = 0, []
    for t in tokens:
        depth += (t == "[[") - (t == "]]")
        if depth < 0:
            raise ValueError(f"{label}: ]] without [[")
        if depth == 0 and t != "]]" and not t.startswith("{{"):
            mandatory.append(t.encode())
    if depth or not tokens or tokens[0] == "[[" or tokens[0].startswith("{{"):
        raise ValueError(f"{label}: regions must be closed and the first word mandatory")
    a = Automaton(label, frozenset(mandatory))
    at, opened = a._state(), []
    for t in tokens:
        if t == "[[":
            opened.append(at)
            new = a._state()
            a.skips[at].add(new)
            at = new
        elif t == "]]":
            new = a._state()
            a.skips[at].add(new)
            a.skips[opened.pop()].add(new)
            at = new
        elif t.startswith("{{"):
            least, most = _bounds(t)
            begin, end = a._state(), a._state()
            a.skips[at].add(begin)
            at = begin
            for filled in range(most + 1):
                if filled >= least:
                    a.skips[at].add(end)
                if filled < most:
                    new = a._state()
                    a.on[at][None] = new
                    at = new
            at = end
        else:
            new = a._state()
            a.on[at][t.encode()] = new
            at = new
    a.final = at
    return a


class Scanner:
    """Base phrases and template automata, applied to one text after the other."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.automata = [compile_template(k, t) for k, t in templates.items()]
        self.starts = [(a, a.firsts()) for a in self.automata]

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        present = set(words)
        base: list[tuple[int, int, str]] = []
        spans: list[tuple[int, int, str]] = []
        for phrase, label in self.phrases:
            if present.issuperset(phrase):
                base += [(i, i + len(phrase), label) for i in _places(words, phrase[0]) if words[i : i + len(phrase)] == phrase]
        for automaton, firsts in self.starts:
            if automaton.mandatory <= present:
                for first in firsts & present:
                    spans += [(i, end, automaton.label) for i in _places(words, first) if (end := automaton.longest(words, i)) is not None]
        covered = len({i for s, e, _ in base + spans for i in range(s, e)})
        starts = [s for s, _, _ in base]
        return (
            len(words),
            len(base),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted({x for *_, x in base})),
            ",".join(sorted({x for *_, x in base + spans})),
            covered / (covered + 2.0),
            [{"label": x, "start": s, "end": e} for s, e, x in sorted(base + spans)],
        )


def all_templates() -> dict[str, str]:
    """Short templates and those of whole licence texts."""
    return TEMPLATES | {label: from_markup(m) for label, m in MARKUP.items()}


def _places(words: list[bytes], word: bytes) -> Iterator[int]:
    i = -1
    try:
        while True:
            i = words.index(word, i + 1)
            yield i
    except ValueError:
        return


def license_column(text: str, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> Column:
    """Struct column with the scan of the text column ``text``.

    ``score`` is c / (c + 2) for c words inside an accepted run, so 0 without a match.
    ``spans`` has every accepted run: label, first word and the word after its last.
    """
    scanner = Scanner(PHRASES if phrases is None else phrases, all_templates() if templates is None else templates)

    @F.pandas_udf(OUTPUT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [scanner.scan(t) for t in texts]
        names = [x.split()[0] for x in OUTPUT.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"})

    return scan(F.col(text))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kinds) -> DataFrame:
    """One row for each row of ``df``: its id and the fields of :func:`license_column`."""
    return df.select(id_col, license_column(text_col, **kinds).alias("_scan")).select(id_col, "_scan.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def _as_regex(template: str) -> str:
    """The template as a regular expression over words that each end with a space."""
    out = ""
    for t in _TOKEN.findall(template):
        out += "(?:" if t == "[[" else ")?" if t == "]]" else "(?:[^ ]+ ){{{},{}}}".format(*_bounds(t)) if t[0] == "{" else f"{t} "
    return out


def _longest_run(template: str) -> int:
    """The words that a run of the template has at most."""
    return sum(0 if t in ("[[", "]]") else _bounds(t)[1] if t[0] == "{" else 1 for t in _TOKEN.findall(template))


def oracle() -> str:
    """DuckDB SQL of the query; runs of words are found by regular expressions over the joined words."""
    parts = {p: p.split() for p in PHRASES}
    templates = all_templates()
    places = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS s, i - 1 + {len(w)} AS e, '{PHRASES[p]}' AS label, true AS base FROM p WHERE w[i:i+{len(w) - 1}] = {w!r}"
        for p, w in parts.items()
    )
    spans = " UNION ALL ".join(
        f"SELECT rid, i - 1, i - 1 + (length(r) - length(replace(r, ' ', ''))), '{k}', false FROM "
        f"(SELECT rid, i, regexp_extract(array_to_string(w[i:i+{_longest_run(t)}], ' ') || ' ', '^{_as_regex(t)}') AS r FROM p WHERE w[i] = '{t.split()[0]}') WHERE r <> ''"
        for k, t in templates.items()
    )
    firsts = sorted({w[0] for w in parts.values()} | {t.split()[0] for t in templates.values()})
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_has_any(w, {firsts!r})),
p AS (SELECT * FROM u WHERE w[i] IN {tuple(firsts)!r}),
m AS ({places} UNION ALL {spans}),
c AS (SELECT rid, count(DISTINCT x) AS covered FROM (SELECT rid, unnest(range(s, e)) AS x FROM m) GROUP BY rid),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS f, max(s) FILTER (base) AS l,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
    coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(covered / (covered + 2.0::DOUBLE), 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (rid) LEFT JOIN c USING (rid)"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": oracle()}
