"""License scans by sentence-rule recognition.

A text is cut into sentences, sentences are normalised, and the normalised
sentence is looked up among the known licence sentences, which gives it an
identifier (with the version or variant it names).  The identifiers of a text
in order are matched against ordered rules: each rule is a sequence of
identifiers that must stand in this order next to each other (unknown sentences
between them may be skipped up to the rule's gap), longer rules first, and a
matched stretch is used once.  Identifiers that no rule uses are reported as
unmatched.

A sentence ends at punctuation or a blank line and may run over wrapped lines;
marks of comments and lists at line starts do not count.  A known sentence may
also begin and end at any line's start and end, as titles and references
without a full stop do; the longest one at a place wins.

The lookup is one hash probe per sentence whatever the size of the sentence
table; only sentences that begin like a known one are normalised.

Defined results: null and empty texts have no sentences and no licences; the
texts of rows with equal ids are read as separate rows; an empty table gives
an empty table; nothing is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import text_batches

#: Known licence sentences (normalised; {v} stands for a version
#: number, {x} for up to 12 words of a name) and their identifiers.
_GPL = "you can redistribute it and or modify it under the terms of the gnu {g} as published by the free software foundation"
_GPL_ENDS = ("either version {v} of the license or at your option any later version", "either version {v} or at your option any later version",
             "version {v} of the license", "version {v}", "either version {v} of the license or any later version", "version {v} of the license only", "version {v} only")
_AS_IS = "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_DAMAGES = ("be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
            "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence "
            "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage")
_MIT_USE = "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
_ASIS_BASIS = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
_GNU = (("general public license", "gpl"), ("lesser general public license", "lgpl"), ("library general public license", "lgpl"), ("affero general public license", "agpl"))
_CC = (("attribution", "cc-by"), ("attribution sharealike", "cc-by-sa"), ("attribution share alike", "cc-by-sa"), ("attribution noncommercial", "cc-by-nc"),
       ("attribution noncommercial sharealike", "cc-by-nc-sa"), ("attribution noncommercial share alike", "cc-by-nc-sa"), ("attribution noncommercial noderivatives", "cc-by-nc-nd"),
       ("attribution noderivatives", "cc-by-nd"))
_REF = ("", "this work is ", "this project is ", "this software is ", "this program is ", "this file is ", "this code is ")

SENTENCES = (
    *((f"{r}{w} under the apache license version {{v}}{e}", "apache-ref") for r in _REF for w in ("licensed", "released", "distributed") for e in ("", " the license")),
    ("{x} licenses this file to you under the apache license version {v} the license", "apache-ref"),
    ("{x} license this file to you under the apache license version {v} the license", "apache-ref"),
    ("you may not use this file except in compliance with the license", "apache-comply"),
    ("you may not use this work except in compliance with the license", "apache-comply"),
    ("you may not use this software except in compliance with the license", "apache-comply"),
    ("you may obtain a copy of the license at", "apache-copy"),
    ("you may obtain a copy of the license in the license file or at", "apache-copy"),
    (_ASIS_BASIS, "apache-asis"),
    (_ASIS_BASIS + " without warranties or conditions of any kind either express or implied", "apache-asis"),
    (_ASIS_BASIS + " without warranty or conditions of any kind either express or implied", "apache-asis"),
    (_ASIS_BASIS + " without warranties or conditions of any kind express or implied", "apache-asis"),
    *((f"{r}{w} under the mit license", "mit-ref") for r in _REF for w in ("licensed", "released", "distributed")),
    (_MIT_GRANT, "mit-grant"),
    *((f"{_MIT_GRANT} the software {_MIT_USE}{e}", "mit-grant") for e in ("", " subject to the following conditions")),
    *((f"the above copyright notice and this permission notice {x}shall be included in all copies or substantial portions of the software", "mit-notice")
      for x in ("", "including the next paragraph ")),
    ("the software is provided as is without warranty of any kind", "as-is"),
    *(("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
       f"fitness for a particular purpose and {n}", "as-is") for n in ("noninfringement", "non infringement")),
    *((f"in no event shall {w} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
       "or in connection with the software or the use or other dealings in the software", "mit-liability")
      for w in ("the authors or copyright holders", "the author or copyright holder", "the author or copyright holders", "{x}")),
    *(("permission to use copy modify and " + o + "distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
       "and this permission notice appear in all copies", "isc-grant") for o in ("", "or ")),
    *((f"redistribution and use in source and binary forms with or without modification are permitted{e}", "bsd-grant")
      for e in ("", " provided that the following conditions are met", " subject to the following conditions")),
    *((f"redistributions of source code must retain the above copyright notice{e}", "bsd-source")
      for e in ("", " this list of conditions and the following disclaimer", " this list of conditions and the following disclaimers")),
    *((f"redistributions in binary form must reproduce the above copyright notice{e}", "bsd-binary")
      for e in ("", *(f" this list of conditions and the following {d} in the documentation and or other materials provided with the distribution" for d in ("disclaimer", "disclaimers")))),
    *((f"all advertising materials mentioning features or use of this software must display the following {w}", "bsd-advert") for w in ("acknowledgement", "acknowledgment")),
    *((f"neither the name{s} of {h} nor the names of {c} may be used to endorse or promote products{e}", "bsd-endorse")
      for s in ("", "s") for h in ("the copyright holder", "the copyright holders", "{x}") for c in ("its contributors", "their contributors", "any contributors", "contributors", "other contributors")
      for e in ("", " derived from this software without specific prior written permission")),
    *((f"this software is provided by {w} as is {_AS_IS}", "bsd-asis") for w in ("the copyright holders and contributors", "the copyright holder and contributors", "the regents and contributors", "{x}")),
    *((f"in no event shall {w} {_DAMAGES}", "bsd-liability") for w in ("the copyright holder or contributors", "the copyright holders or contributors", "the copyright owner or contributors", "{x}")),
    *((f"{r}{w} under the gnu {g} version {{v}}{e}", f"{i}-ref") for g, i in _GNU for r in _REF for w in ("licensed", "released", "distributed") for e in ("", " or later", " or any later version", " only")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-grant"),
    *((f"{_GPL.replace('{g}', g)} {e}", f"{i}-grant") for g, i in _GNU for e in _GPL_ENDS),
    *((f"this source code form is subject to the terms of the mozilla public license {v}{{v}}", "mpl-ref") for v in ("v ", "version ", "")),
    *((f"licensed under cc {c.removeprefix('cc-').replace('-', ' ')} {{v}}", c) for c in sorted({c for _, c in _CC})),
    *((f"this work is licensed under {a}creative commons {n} {{v}} {p}license", c) for n, c in _CC for a in ("a ", "the ") for p in ("", "international ", "unported ", "generic ")),
    ("this work is dedicated to the public domain", "cc0"),
    ("all rights reserved", "all-rights"),
)


@dataclass(frozen=True)
class LicenseRule:
    """``sequence`` of identifiers in order; up to ``gap`` unknown sentences
    may stand between two of them."""
    license: str
    sequence: tuple[str, ...]
    gap: int = 2


#: Ordered rules: the first that fits at a place wins.
RULES = (
    LicenseRule("Apache", ("apache-ref", "apache-comply", "apache-copy", "apache-asis")),
    LicenseRule("Apache", ("apache-ref",)),
    LicenseRule("MIT", ("mit-grant", "mit-notice", "as-is", "mit-liability")),
    LicenseRule("MIT", ("mit-grant", "mit-notice", "as-is")),
    LicenseRule("MIT", ("mit-ref",)),
    LicenseRule("ISC", ("isc-grant",)),
    LicenseRule("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-asis", "bsd-liability")),
    LicenseRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liability")),
    LicenseRule("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    LicenseRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    LicenseRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability")),
    LicenseRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    LicenseRule("GPL", ("gpl-ref",)),
    LicenseRule("GPL", ("gpl-grant",)),
    LicenseRule("LGPL", ("lgpl-ref",)),
    LicenseRule("LGPL", ("lgpl-grant",)),
    LicenseRule("AGPL", ("agpl-ref",)),
    LicenseRule("AGPL", ("agpl-grant",)),
    LicenseRule("MPL", ("mpl-ref",)),
    LicenseRule("CC-BY-NC-ND", ("cc-by-nc-nd",)),
    LicenseRule("CC-BY-NC-SA", ("cc-by-nc-sa",)),
    LicenseRule("CC-BY-NC", ("cc-by-nc",)),
    LicenseRule("CC-BY-ND", ("cc-by-nd",)),
    LicenseRule("CC-BY-SA", ("cc-by-sa",)),
    LicenseRule("CC-BY", ("cc-by",)),
    LicenseRule("CC0", ("cc0",)),
    LicenseRule("Proprietary", ("all-rights",)),
)

_END = re.compile(r"(?<!\bv)(?<!\bInc)(?<!\bLtd)(?<!\bCorp)(?<!\bCo)[.!?;:](?=\s|$)|\n")
#: What stands before the words of a line: marks of comments, quotes and lists.
_MARK = re.compile(r"[ \t]*(?:(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--|>+|!+|(?:rem|dnl)(?=\s)|\(?\d{1,2}\)|\(?[a-z]\)|[-\u2022|'])[ \t]*)*", re.I)
_FIRST = re.compile(r"[^\W_]")
_NOT_WORD = re.compile(r"[\W_]+")
_VERSION = re.compile(r"(?<![\w.])v?(\d+(?:\.\d+)*)(?![\w.]*\w)", re.I)


def normalise(sentence: str) -> tuple[str, str]:
    """(normalised form, version): lower case, version numbers as {v},
    everything else that is not a letter or digit as one space."""
    version = _VERSION.search(sentence)
    marked = _VERSION.sub(" \x00 ", sentence)
    words = " ".join("{v}" if w == "\x00" else w for p in re.split("(\x00)", marked) for w in ([p] if p == "\x00" else _NOT_WORD.sub(" ", p.lower()).split()))
    return words, version.group(1) if version else ""


def pieces(text: str) -> Iterator[tuple[str, int]]:
    """(piece, how it ends) of the whole text, cut at . ! ? ; or : before white space and
    at line ends: 2 for . ! ? and blank lines, 1 for ; and :, over which a known
    sentence may run, 0 for line ends, which end no sentence."""
    last = None
    at = _MARK.match(text).end()
    while at <= len(text):
        m = _END.search(text, at)
        end, piece = (m.start(), text[at:m.start()].strip()) if m else (len(text), text[at:].strip())
        soft = bool(m) and m.group() == "\n"
        words = bool(_FIRST.search(piece))
        if last is not None and (words or soft):
            # a line feed after a piece without words: a blank line, or the rest of an ended line
            yield last[0], last[1] if words or last[1] else 2
            last = None
        if words:
            last = (piece, 0 if soft else 1 if m and m.group() in ";:" else 2)
        if m is None:
            break
        at = m.end()
        if soft:
            at = _MARK.match(text, at).end()
    if last is not None:
        yield last[0], 2


class Known:
    """The sentence table made ready: whole sentences by hash, those with a name by patterns."""

    def __init__(self, table: Sequence[tuple[str, str]]):
        self.plain = {s: i for s, i in table if "{x}" not in s}
        named = [(s, i) for s, i in table if "{x}" in s]
        self.starts = frozenset(" ".join(w[:k]) for s, _ in table for w in [s.partition("{x}")[0].split()] for k in range(1, len(w) + ("{x}" in s)))
        #: (words before the name, pattern of the whole, of any beginning, identifier)
        self.named = []
        name = r"\S+(?: \S+){0,11}"
        for s, i in named:
            head, _, tail = s.partition("{x}")
            rest = ""
            for w in reversed(tail.split()):
                rest = f"(?: {re.escape(w)}{rest})?"
            self.named.append((head.strip(), re.compile(re.escape(head) + name + re.escape(tail)), re.compile(re.escape(head) + name + rest), i))
        # a known sentence begins with the first word of a table entry: a cheap look before normalising;
        # where the name comes first, with any word before the first one after it
        firsts = sorted({re.escape(s.split()[0]) for s, _ in table if not s.startswith("{x}")})
        self.likely = re.compile(r"(?<![^\W_])(?:" + "|".join(firsts) + r")(?![^\W_])", re.I)
        marks = sorted({re.escape(s.split()[1]) for s, _ in table if s.startswith("{x}")})
        self.marks = re.compile(r"(?<![^\W_])(?:" + "|".join(marks or ["(?!)"]) + r")(?![^\W_])", re.I)

    def get(self, form: str) -> str | None:
        if form in self.plain:
            return self.plain[form]
        return next((i for head, whole, _, i in self.named if form.startswith(head) and whole.fullmatch(form)), None)

    def begins(self, form: str) -> bool:
        """Whether a known sentence begins with these words."""
        return form in self.starts or any(form.startswith(head) and start.fullmatch(form) for head, _, start, _ in self.named)


def find(text: str, known: Known) -> list[tuple[int, str, str]]:
    """(place, identifier, version) of the known sentences of a text; a place is the
    sentence's number."""
    cut = list(pieces(text))
    forms: dict[int, tuple[str, str]] = {}
    out, i, n, unknown = [], 0, 0, False         # unknown: lines of an unknown sentence stand before
    while i < len(cut):
        first = _FIRST.search(cut[i][0])
        best = None
        if known.likely.match(cut[i][0], first.start()) or known.marks.search(cut[i][0]):
            form, version = "", ""
            for j in range(i, len(cut)):
                if j not in forms:
                    forms[j] = normalise(cut[j][0])
                form, version = f"{form} {forms[j][0]}".strip(), version or forms[j][1]
                if (got := known.get(form)) is not None:
                    best = (j, got, version)
                if cut[j][1] == 2 or not known.begins(form):
                    break
        if best:
            n += unknown
            out.append((n, *best[1:]))
            i, n, unknown = best[0] + 1, n + 1, False
        else:
            n, unknown, i = n + (cut[i][1] > 0), not cut[i][1], i + 1
    return out


def match_rules(found: Sequence[tuple[int, str, str]], rules: Sequence[LicenseRule] = RULES) -> tuple[list[tuple[str, int, int]], list[str]]:
    """(licence, first place, last place) of the rules that fit the identifiers
    [(place, identifier, version)] of one text, and the identifiers left over."""
    out, left, i = [], [], 0
    while i < len(found):
        for r in rules:
            part = found[i:i + len(r.sequence)]
            near = all(b[0] - a[0] - 1 <= r.gap for a, b in zip(part, part[1:]))
            if tuple(x[1] for x in part) == r.sequence and near:
                version = next((x[2] for x in part if x[2]), "")
                out.append((f"{r.license}-{version}" if version else r.license, part[0][0], part[-1][0]))
                i += len(part)
                break
        else:
            left.append(found[i][1])
            i += 1
    return out, left


def _find_fn(table: Sequence[tuple[str, str]]):
    known = Known(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for text in b.column(1).to_pylist():
                got = find(text, known) if text and (known.likely.search(text) or known.marks.search(text)) else []
                ids.append([{"place": at, "id": i, "version": v} for at, i, v in got])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.struct([("place", pa.int32()), ("id", pa.string()), ("version", pa.string())])))],
                                             ["__row", "__ids"])
    return run


def scan(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), table: Sequence[tuple[str, str]] = SENTENCES,
         rules: Sequence[LicenseRule] = RULES) -> DataFrame:
    """``keep`` columns, sentence_ids (identifiers in order), licenses (one per
    match, in order), spans (first and last sentence of each match), unmatched."""
    text_batches(docs.sparkSession)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    ids = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("version", T.StringType())]))
    found = d.mapInArrow(_find_fn(tuple(table)), T.StructType([d.schema["__row"], T.StructField("__ids", ids)]))
    rules = tuple(rules)

    def run(batches):
        for b in batches:
            lic, spans, left = [], [], []
            for x in b.column(1).to_pylist():
                got, rest = match_rules([(i["place"], i["id"], i["version"]) for i in x], rules)
                lic.append([g[0] for g in got])
                spans.append([{"first": g[1], "last": g[2]} for g in got])
                left.append(rest)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lic, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                                              pa.array(left, pa.list_(pa.string()))], [*b.schema.names, "__lic", "__spans", "__left"])

    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    out = found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("__lic", T.ArrayType(T.StringType())), T.StructField("__spans", span),
                                              T.StructField("__left", T.ArrayType(T.StringType()))]))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], F.col("__ids.id").alias("sentence_ids"), F.col("__lic").alias("licenses"),
                      F.col("__spans").alias("spans"), F.col("__left").alias("unmatched"))
