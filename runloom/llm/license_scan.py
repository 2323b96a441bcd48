"""Operator 5: licences by their sentences.

Texts are cut at sentence ends and line breaks; pieces are normalised (lower case, letters, digits
and dots of versions only). A piece, or several in a row where a sentence was wrapped, that is a
known licence sentence becomes its identifier; SPDX marks are one more. The row of identifiers is then matched against
ordered rules, longer ones first: a rule holds where its identifiers follow each other with few
other pieces between. Identifiers that no rule takes up are reported as unmatched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identifier of a licence sentence and the pattern of its normalised form.
SENTENCES = (
    ("apache-ref", r"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?apache license(?: version)? v?2(?:\.0)?(?: the license)?"),
    ("apache-title", r"apache license version 2(?:\.0)?(?: january 2004)?"),
    ("apache-use", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at(?: .*)?"),
    ("apache-asis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-ref", r"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?mit license"),
    ("mit-title", r"(?:the )?mit license(?: mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .* subject to the following conditions"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("asis", r"the software is provided as is without warranty of any kind express or implied .*"),
    ("no-liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability .*"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted .*"),
    ("isc-asis", r"the software is provided as is and the author disclaims all warranties .*"),
    ("bsd-ref", r"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?(?:(?P<bsd>[23]) clause )?bsd(?: (?P<bsd2>[23]) clause)? license"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:\d\.? )?redistributions of source code must retain the above copyright notice .*"),
    ("bsd-binary", r"(?:\d\.? )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("bsd-endorse", r"(?:\d\.? )?neither the name of .* may be used to endorse or promote products derived from this software .*"),
    ("bsd-asis", r"this software is provided by .* as is and any express or implied warranties .* are disclaimed"),
    ("gpl-ref", r"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu (?P<gnu>lesser |library |affero )?general public license(?: version)? v?(?P<version>\d(?:\.\d)?)(?P<later> or (?:at your option )?(?:any )?later(?: version)?)?"),
    ("gpl-title", r"gnu (?P<gnu3>lesser |library |affero )?general public license version (?P<version3>\d(?:\.\d)?)(?: \d+ \w+ \d{4})?"),
    ("gpl-free", r"this (?:program|library) is free software you can redistribute it and or modify it under the terms of the gnu (?P<gnu2>lesser |library |affero )?general public license as published by the free software foundation either version (?P<version2>\d(?:\.\d)?) of the license or at your option any later version"),
    ("gpl-hope", r"this (?:program|library) is distributed in the hope that it will be useful but without any warranty .*"),
    ("gpl-see", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("mpl-ref", r"this source code form is subject to the terms of the mozilla public license v\.? ?2\.0"),
    ("mpl-title", r"mozilla public license version 2(?:\.0)?"),
    ("mpl-short", r"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?mozilla public license(?: version)? v?2(?:\.0)?"),
    ("cc-ref", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:an? |the )?(?:cc|creative commons) (?P<cc>(?:by|attribution)(?: (?:nc|noncommercial|non commercial))?(?: (?:sa|sharealike|share alike|nd|noderivatives|no derivatives))?) (?P<ccv>\d\.\d)(?: international)?(?: license)?"),
    ("cc0-ref", r"(?:cc0 1\.0|public domain dedication)(?: universal)?(?: license)?"),
    ("gpl-free-only", r"this (?:program|library) is free software you can redistribute it and or modify it under the terms of (?:version (?P<version4>\d(?:\.\d)?) of )?the gnu (?P<gnu4>lesser |library |affero )?general public license(?: version (?P<version5>\d(?:\.\d)?))?(?: only)? as published by the free software foundation(?: version (?P<version6>\d(?:\.\d)?)(?: of the license)?)?"),
    ("zlib-asis", r"this software is provided as is without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib-origin", r"(?:\d\.? )?the origin of this software must not be misrepresented you must not claim that you wrote the original software .*"),
    ("zlib-altered", r"(?:\d\.? )?altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib-notice", r"(?:\d\.? )?this notice may not be removed or altered from any source distribution"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
)

# Names of licences that are referred to by name, and the words that name them once normalised. With versions in place of {}.
NAMES = {
    "MIT": ("mit", "expat", "mit x11", "mit expat"), "ISC": ("isc",), "Zlib": ("zlib", "zlib libpng"), "BSL-1.0": ("boost software", "boost software 1.0", "boost software version 1.0", "boost 1.0", "bsl 1.0"),
    "0BSD": ("0bsd", "zero clause bsd"), "BSD-2-Clause": ("simplified bsd", "freebsd", "bsd 2 clause", "2 clause bsd", "two clause bsd"), "BSD-3-Clause": ("new bsd", "modified bsd", "revised bsd", "bsd 3 clause", "3 clause bsd", "three clause bsd"),
    "LicenseRef-BSD": ("bsd", "bsd style", "a bsd style"), "Apache-{}": ("apache {}", "apache version {}", "apache software {}", "asl {}", "asl version {}"), "EPL-{}": ("eclipse public {}", "eclipse public version {}", "eclipse public v {}", "epl {}", "epl v{}"),
    "MPL-{}": ("mozilla public {}", "mozilla public version {}", "mpl {}", "mpl v{}", "mpl version {}"), "Unlicense": ("unlicense",), "WTFPL": ("wtfpl", "do what the fuck you want to public"), "PSF-2.0": ("python software foundation", "psf", "psf 2.0"),
    "GPL-{}": ("gpl {}", "gpl v{}", "gplv{}", "gpl version {}", "gnu gpl {}", "gnu gpl v{}", "gnu gplv{}", "gnu gpl version {}", "gnu general public {}", "gnu general public v{}", "gnu general public version {}"),
    "LGPL-{}": ("lgpl {}", "lgpl v{}", "lgplv{}", "lgpl version {}", "gnu lgpl {}", "gnu lgpl v{}", "gnu lgplv{}", "gnu lgpl version {}", "gnu lesser general public {}", "gnu lesser general public v{}", "gnu lesser general public version {}"),
    "AGPL-{}": ("agpl {}", "agpl v{}", "agplv{}", "agpl version {}", "gnu agpl {}", "gnu agpl v{}", "gnu agplv{}", "gnu agpl version {}", "gnu affero general public {}", "gnu affero general public v{}", "gnu affero general public version {}"),
    "CC-BY-{}": ("cc by {}", "creative commons attribution {}"), "CC-BY-SA-{}": ("cc by sa {}", "creative commons attribution sharealike {}"), "CC-BY-NC-{}": ("cc by nc {}", "creative commons attribution noncommercial {}"), "CC-BY-ND-{}": ("cc by nd {}",),
    "CC-BY-NC-SA-{}": ("cc by nc sa {}",), "CC-BY-NC-ND-{}": ("cc by nc nd {}",), "CC0-1.0": ("cc0", "cc0 1.0", "creative commons zero"),
}
# Versions of the licences that have them.
VERSIONS = {"Apache": ("1.1", "2.0"), "EPL": ("1.0", "2.0"), "MPL": ("1.1", "2.0"), "GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",), "CC": ("1.0", "2.0", "2.5", "3.0", "4.0")}

# A licence's name and its identifiers in order; {} takes what a sentence's pattern captured.
RULES = (
    ("Apache-2.0", ("apache-ref", "apache-use", "apache-copy", "apache-asis", "apache-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "asis", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "asis", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "asis")),
    ("{gnu}", ("gpl-free", "gpl-hope", "gpl-see")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("{gnu}", ("gpl-free",)),
    ("{gnu}", ("gpl-ref",)),
    ("{gnu}", ("gpl-title",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-title",)),
    ("MIT", ("mit-ref",)),
    ("BSD-{bsd}-Clause", ("bsd-ref",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("MPL-2.0", ("mpl-short",)),
    ("MPL-2.0", ("mpl-title",)),
    ("{cc}", ("cc-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-asis", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("BSL-1.0", ("boost-grant",)),
    ("{gnu}", ("gpl-free-only", "gpl-hope", "gpl-see")),
    ("{gnu}", ("gpl-free-only",)),
    ("{named}", ("named-ref",)),
    ("{spdx}", ("spdx",)),
)
#: Every known sentence holds one of these, in any case, with anything but letters and digits between the words.
TRIGGERS = ("released under", "available under", "provided under", "published under", "code under", "distributed under", "creative commons", "licens", "permission", "copyright", "redistribut", "warrant", "free software", "free and unencumbered", "public domain", "cc0", "the software is provided", "liable", "neither the name")
#: Other pieces that may stand between two sentences of a rule.
GAP = 3

#: A mark and its expression, in the text as it is: names joined by operators in capitals, in brackets or not. What follows is no part of it.
_SPDX = re.compile(r"spdx-license-identifier:\s*((?-i:\(?[A-Za-z0-9.+-]*[A-Za-z0-9+]\)*(?:\s+(?:OR|AND|WITH)\s+\(*[A-Za-z0-9.+-]*[A-Za-z0-9+]\)*)*))", re.I)


def _regex(pattern: str, last: bool) -> re.Pattern:
    lazy = pattern.replace("(?: .*)?", "(?: .*)??").replace(".*", ".*?").replace(".*??", ".*?")
    return re.compile(lazy.replace(" ", r"[ \n]") + (r"(?=\n|\Z)" if last else ""), re.S)


class Pattern:
    """A sentence's pattern over pieces that are joined by line feeds: it begins where it is tried, ends where a piece ends, and takes no more than it must of any text.

    Where any text may stand inside, the parts after it are found once in the joined text and looked
    up by their place, so however many sentences begin, none reads on to the end of the text.
    """

    def __init__(self, name: str, pattern: str) -> None:
        self.name = name
        parts = pattern.split(" .* ")
        self.head, self.rest = _regex(parts[0] + (" " if len(parts) > 1 else ""), len(parts) == 1), [_regex(" " + p + (" " if i < len(parts) - 1 else ""), i == len(parts) - 1) for i, p in enumerate(parts[1:], 1)]

    def match(self, joined: str, at: int, places: dict[tuple[str, int], tuple[list[int], list[int]]]) -> tuple[int, dict[str, str]] | None:
        """Where it ends and what it captured."""
        m = self.head.match(joined, at)
        if not m:
            return None
        end = m.end()
        for i, part in enumerate(self.rest):
            if (self.name, i) not in places:
                found = [(x.start(), x.end()) for x in part.finditer(joined)]
                places[self.name, i] = ([x for x, _ in found], [x for _, x in found])
            begins, ends = places[self.name, i]
            k = bisect_left(begins, end)
            if k == len(begins):
                return None
            end = ends[k]
        return end, m.groupdict()


_PATTERNS = tuple(Pattern(name, pattern) for name, pattern in SENTENCES)


def _names() -> dict[str, str]:
    """Normalised names of licences, with and without "license", and what they name."""
    out = {}
    for name, phrases in NAMES.items():
        for version in VERSIONS[name.split("-")[0]] if "{}" in name else ("",):
            short = {version, version.removesuffix(".0")} if "{}" in name else {""}
            for phrase in phrases:
                for written in short:
                    words = phrase.format(written)
                    for form in (words, f"{words} license", f"{words} licence", f"{words} international", f"{words} international license", f"license {words}", words.replace(written, f"license {written}", 1) if written else words, words.replace("version", "license version")):
                        out[form] = name.format(version)
    return out


_NAMED = _names()
_LONGEST = max(map(len, _NAMED))
#: A reference by name: what may stand before the name, the name, and "or later".
_REF = re.compile(r"(?:(?:licensed|released|distributed|available|provided|published|code)[ \n](?:is[ \n])?under[ \n](?:an?[ \n]|the[ \n])?(?:terms[ \n]of[ \n](?:the[ \n])?)?|(?=[a-z0-9. \n]{2,40}[ \n]licensed(?:\n|\Z)))")
_REF_END = re.compile(r"[ \n]or[ \n](?:at[ \n]your[ \n]option[ \n])?(?:any[ \n])?(?:later|newer)(?:[ \n]version)?(?=\n|\Z)")


def named_reference(joined: str, at: int) -> tuple[int, dict[str, str]] | None:
    """A reference that begins at a place and ends where a piece ends, the longest by a look-up of the name."""
    m = _REF.match(joined, at)
    if not m:
        return None
    found = None
    for cut in re.finditer(r"\n|\Z", joined[m.end() : m.end() + _LONGEST + 40]):
        words = joined[m.end() : m.end() + cut.start()].replace("\n", " ")
        later = _REF_END.search(words)
        name = words[: later.start()] if later else words.removesuffix(" licensed") if m.end() == at else words
        if name in _NAMED and (m.end() > at or words.endswith(" licensed")):
            spdx = _NAMED[name]
            gnu = re.match("(?:GPL|LGPL|AGPL)-", spdx)
            found = m.end() + cut.start(), {"named": f"{spdx}-{'or-later' if later else 'only'}" if gnu else spdx}
    return found


_TRIGGER = re.compile("|".join(t.replace(" ", "[^a-z0-9]+") for t in TRIGGERS))
_CUT = re.compile(r"(?<=[.!?;:])\s+|\n+")
_DROP = re.compile(r"[^a-z0-9.]+|\.(?!\d)|(?<!\d)\.")
_START = re.compile(r"(?:this|the|you|see|unless|permission|redistribution|redistributions|neither|in no|in$|licensed|released|distributed|available|provided|published|code|altered|mit|apache|gnu|mozilla|\d|cc0|public)\b|[a-z0-9. ]{2,40} licensed$")
#: What may stand before a sentence in its first piece: any words before a mark, and a subject with its verb.
_BEFORE = re.compile(r".*\b(?=(?:cc0|public(?: domain|$))\b)|.*\b(?:is|are) (?:also |hereby |made )?(?=(?:licensed|released|distributed|available|provided|published)\b)|(?:[a-z]+ )?(?=code under\b)")
#: Words before a sentence that turn it into its opposite.
_DENIED = re.compile(r"\b(?:nothing|none|not|no|never|neither|nor|cannot|without|isn t|aren t|unless|if|whether)\b")


@dataclass(frozen=True)
class Sentence:
    name: str
    first: int
    last: int
    begin: int
    end: int
    captured: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Match:
    license: str
    begin: int
    end: int
    sentences: int


def normalised(piece: str) -> str:
    return " ".join(_DROP.sub(" ", piece.lower()).split())


def _pieces(text: str) -> list[tuple[str, int, int]]:
    """Normalised pieces that have words, with their places in the text."""
    out, at = [], 0
    for cut in [*_CUT.finditer(text), None]:
        end = cut.start() if cut else len(text)
        if words := normalised(text[at:end]):
            out.append((words, at, end))
        at = cut.end() if cut else end
    return out


def known_sentences(text: str | None) -> list[Sentence]:
    """Licence sentences in order; where several begin at a piece, the one that ends last.

    A sentence may have a subject and "is" or "are" before its verb, and an identifier of a licence may
    have any words before it, in the piece that it begins in. Neither the length of pieces nor their
    number matters. SPDX marks are found first, and their pieces belong to no other sentence.
    """
    if not text or not _TRIGGER.search(text.lower()):
        return []
    pieces = _pieces(text)
    ends = np.cumsum([len(words) + 1 for words, _, _ in pieces]).tolist()  # of each piece in the joined text, with the line feed
    joined, found, i = "\n".join(words for words, _, _ in pieces), [], 0
    marks, places = _marks(text, pieces), {}
    marked = sorted(marks)
    while i < len(pieces):
        if i in marks:
            found.append(marks[i])
            i = marks[i].last + 1
            continue
        begin, best, reach = ends[i] - len(pieces[i][0]) - 1, None, 0
        for start in _starts(pieces[i][0]):
            tried = [(p.name, p.match(joined, begin + start, places)) for p in _PATTERNS]
            if not any(m for _, m in tried):
                tried = [("named-ref", named_reference(joined, begin + start))]
            for name, m in tried:
                if m and m[0] > reach:
                    last = bisect_left(ends, m[0] + 1)
                    k = bisect_left(marked, i)
                    if k == len(marked) or marked[k] > last:
                        reach = m[0]
                        best = Sentence(name, i, last, pieces[i][1], pieces[last][2], tuple((k, " ".join(v.split())) for k, v in m[1].items() if v))
            if best:
                break
        if best:
            found.append(best)
        i = best.last + 1 if best else i + 1
    return found


def _marks(text: str, pieces: list[tuple[str, int, int]]) -> dict[int, Sentence]:
    """SPDX marks by the piece that they begin in; the first of a piece counts."""
    out: dict[int, Sentence] = {}
    places = [end for _, _, end in pieces]
    for m in _SPDX.finditer(text):
        first, last = bisect_left(places, m.start() + 1), bisect_left(places, m.end())
        if not out or first > next(reversed(out.values())).last:
            out[first] = Sentence("spdx", first, last, pieces[first][1], pieces[last][2], (("spdx", " ".join(m[1].split())),))
    return out


def _starts(piece: str) -> list[int]:
    """Where in its first piece a sentence can begin: at once, and after what may stand before it."""
    out = [0] if _START.match(piece) else []
    if (m := _BEFORE.match(piece)) and m.end() and not _DENIED.search(m[0]):
        out.append(m.end())
    return out


#: Names of the rules by their capitals: an SPDX mark in any case names the same licence as a rule does.
_SPELLED = {name.upper(): name for name in (*_NAMED.values(), *(f"{n}-{end}" for n in _NAMED.values() if re.match("(?:GPL|LGPL|AGPL)-", n) for end in ("only", "or-later")))}


def spdx_names(expression: str) -> list[str]:
    """Licences of an SPDX expression, as the rules spell them, others as they are written; an exception stays with its licence."""
    plain = " ".join(expression.replace("(", " ").replace(")", " ").split())
    return [" WITH ".join(_SPELLED.get(x.upper(), x) for x in name.split(" WITH ")) for name in re.split(" (?:OR|AND) ", plain)]


def _name(template: str, captured: dict[str, str]) -> str:
    if template == "{gnu}":
        kind = {"lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}.get(next((captured[k] for k in ("gnu", "gnu2", "gnu3", "gnu4") if k in captured), ""), "GPL")
        version = next((captured[k] for k in ("version", "version2", "version3", "version4", "version5", "version6") if k in captured), "1.0")
        later = "or-later" if "later" in captured or "version2" in captured else "only"
        return f"{kind}-{version if '.' in version else version + '.0'}-{later}"
    if template == "{cc}":
        short = {"attribution": "BY", "by": "BY", "nc": "NC", "noncommercial": "NC", "commercial": "NC", "sa": "SA", "sharealike": "SA", "alike": "SA", "nd": "ND", "noderivatives": "ND", "derivatives": "ND"}
        return "-".join(["CC", *(short[w] for w in captured["cc"].split() if w in short), captured["ccv"]])
    if template == "{named}":
        return captured["named"]
    return template.format(bsd=captured.get("bsd") or captured.get("bsd2") or "3")


def _chain(found: list[Sentence], used: list[bool], start: int, names: tuple[str, ...]) -> list[int]:
    """Places of a rule's sentences from a start on; none if it does not hold there."""
    chain: list[int] = []
    for at, want in enumerate(names, start):
        far = chain and at < len(found) and found[at].first - found[chain[-1]].last - 1 > GAP
        if at >= len(found) or used[at] or found[at].name != want or far:
            return []
        chain.append(at)
    return chain


def match_rules(found: list[Sentence]) -> tuple[list[Match], list[str]]:
    """Licences by the rules, in the order of the text, and the identifiers left over. No sentence serves two rules."""
    used, matches = [False] * len(found), []
    for template, names in RULES:
        for start in range(len(found)):
            if chain := _chain(found, used, start, names):
                for k in chain:
                    used[k] = True
                captured = {k: v for i in chain for k, v in found[i].captured}
                names_ = spdx_names(captured["spdx"]) if template == "{spdx}" else [_name(template, captured)]
                matches += [Match(name, found[start].begin, found[chain[-1]].end, len(chain)) for name in names_]
    matches.sort(key=lambda m: (m.begin, m.end))
    return matches, [s.name for s, u in zip(found, used, strict=True) if not u]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("licenses", pa.list_(pa.string())), ("unmatched", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("sentences", pa.int64())]))),
])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            found = known_sentences(text.as_py())
            matches, rest = match_rules(found) if found else ([], [])
            rows.append({"doc_id": doc, "n_sentences": len(found), "licenses": sorted({m.license for m in matches}), "unmatched": rest, "matches": [m.__dict__ for m in matches]})
        yield pa.RecordBatch.from_pylist(rows, _OUT)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, licenses (sorted names), unmatched (identifiers) and matches (license, begin, end, sentences) of every row of ``docs`` (doc_id, text; others are ignored).

    Places are in code points. Null and empty texts have nothing; repeated rows get equal results; an
    empty table gives none. Nothing is shuffled.
    """
    kind = "doc_id long, n_sentences long, licenses array<string>, unmatched array<string>, matches array<struct<license: string, begin: long, end: long, sentences: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, kind)
