"""Licences by sentence rules: sentences become identifiers, identifier sequences become licences.

Comment marks go, the lines of a paragraph are read as one text and cut into sentences. A known licence
sentence may begin where a sentence, a line or a part after a semicolon or colon begins, run over any number
of lines of its sentence, and must end where one of them ends. The identifiers found, in their order, are then matched against the licence rules: a
rule is a sequence of identifiers that must follow each other, and earlier rules take their
sentences first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import column, slices

# The wording of licences, as normalised sentences ({v} stands for a version), and
# {any} for the words between, over lines), and the licences that sequences of them name. They are stated plainly and in order.
SENTENCES = [
    ("apache-notice", r"licensed under the apache license,? version {v}(?: \(the license\))?"),
    ("apache-may-not-use", r"you may not use this file except in compliance with the license"),
    ("apache-copy-at", r"you may obtain a copy of the license at.*"),
    ("apache-as-is", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis.*"),
    ("gpl-work", r"(?:this (?:work|program|software|file) is )?licensed under the gnu general public license,? version {v}(?: or (?:any )?later)?"),
    ("gpl-free-software", r"this (?:program|library|file) is free software[:;]? you can redistribute it and/or modify it under the terms of the gnu general public license,? as published by the free software foundation{any}version {v}.*"),
    ("lgpl-free-software", r"this (?:program|library|file) is free software[:;]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license,? as published by the free software foundation{any}version {v}.*"),
    ("agpl-free-software", r"this (?:program|library|file) is free software[:;]? you can redistribute it and/or modify it under the terms of the gnu affero general public license,? as published by the free software foundation{any}version {v}.*"),
    ("lgpl-work", r"(?:this (?:work|program|software|library|file) is )?licensed under the gnu lesser general public license,? version {v}(?: or (?:any )?later)?"),
    ("agpl-work", r"(?:this (?:work|program|software|file) is )?licensed under the gnu affero general public license,? version {v}(?: or (?:any )?later)?"),
    ("gpl-no-warranty", r"this (?:program|library|file) is distributed in the hope that it will be useful,? but without any warranty.*"),
    ("gpl-received", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library|file).*"),
    ("mit-released", r"(?:this (?:work|program|software|file) is )?(?:released|licensed|distributed) under the (?:terms of the )?mit license"),
    ("mit-permission", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software.*"),
    ("mit-include", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", r"the software is provided as is,? without warranty of any kind.*"),
    ("bsd-redistribution", r"redistribution and use in source and binary forms,? with or without modification,? are permitted.*"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-endorse", r"neither the name of{any}may be used to endorse or promote products derived from this software.*"),
    ("bsd-as-is", r"this software is provided by the copyright holders and contributors as is.*"),
    ("mpl-notice", r"this source code form is subject to the terms of the mozilla public license,? v(?:ersion|\.)? ?{v}"),
    ("isc-permission", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("cc-notice", r"(?:this (?:work|text|document) is )?licensed under (?:a |the )?(?:cc|creative commons) (?P<kind>by(?:-(?:nc|nd|sa))*) {v}(?: international)?"),
    ("cc0-notice", r"(?:this (?:work|text|document) is )?(?:licensed|released) under cc0(?: {v})?"),
    ("spdx", r"spdx-license-identifier: (?P<kind>[a-z0-9.+-]+)"),
    ("all-rights", r"all rights reserved"),
]
RULES = [
    ("Apache-{v}", ["apache-notice", "apache-may-not-use", "apache-copy-at", "apache-as-is"]),
    ("Apache-{v}", ["apache-notice"]),
    ("GPL-{v}", ["gpl-free-software", "gpl-no-warranty", "gpl-received"]),
    ("GPL-{v}", ["gpl-free-software"]),
    ("LGPL-{v}", ["lgpl-free-software", "gpl-no-warranty", "gpl-received"]),
    ("LGPL-{v}", ["lgpl-free-software"]),
    ("AGPL-{v}", ["agpl-free-software", "gpl-no-warranty", "gpl-received"]),
    ("AGPL-{v}", ["agpl-free-software"]),
    ("GPL-{v}", ["gpl-work"]),
    ("LGPL-{v}", ["lgpl-work"]),
    ("AGPL-{v}", ["agpl-work"]),
    ("MIT", ["mit-permission", "mit-include", "mit-as-is"]),
    ("MIT", ["mit-permission"]),
    ("MIT", ["mit-released"]),
    ("BSD-3-Clause", ["all-rights", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-2-Clause", ["all-rights", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-redistribution"]),
    ("MPL-{v}", ["mpl-notice"]),
    ("ISC", ["isc-permission"]),
    ("CC-{kind}-{v}", ["cc-notice"]),
    ("CC0-{v}", ["cc0-notice"]),
    ("SPDX-{kind}", ["spdx"]),
    ("Proprietary", ["all-rights"]),
]
#: A text without any of these cannot hold a known sentence. They are single words, which no line end divides.
HINTS = ("licen", "permission", "redistribution", "warranty", "reserved", "cc0", "provided", "neither", "notice", "distributed", "spdx")

#: Where a known sentence may end: at the end of a line or sentence, or before a semicolon.
_END = r"(?=[ .!?,:]*(?:[;\n]|\Z))"


def _compiled(pattern: str) -> re.Pattern:
    """The pattern over normalised lines: every blank of it may be a line's end."""
    end = r"\b" if pattern.endswith(".*") else _END
    spaced = pattern.removesuffix(".*").replace(" ", "[ \n]").replace("{any}", r"\b(?s:.{0,300}?)\b")
    return re.compile(spaced.replace("{v}", r"(?P<v>[0-9]+(?:\.[0-9]+)*)") + end)


_KNOWN = [(name, _compiled(pattern)) for name, pattern in SENTENCES]
#: Known sentences begin with one of these words.
_OPENS = re.compile(r"(?:licensed|you|unless|this|permission|the|redistributions?|neither|spdx-license-identifier|all|released|distributed)\b")
#: Sentences end at a full stop (but not that of "v. 2.0"), exclamation or question mark before white space.
_STOP = re.compile(r"(?<!\bv)[.!?](?=\s|\Z)|(?<=\bv)\.(?=\s+[^\s0-9])")
_BEGIN = re.compile(r"(?:\A|\n|[;:](?=\s))[\s,:;]*")
_QUOTES = re.compile(r"[\"“”‘’`]|(?<!\w)'|'(?!\w)")
_LINE_OPENS = re.compile(r"\A(?:(?:dnl|rem)\s+)?(?:\(?(?:[0-9]{1,2}|[a-z])\)\s+)?")
_MARKS = re.compile(r"(?<!\S)[*#/;%-]++(?=\s|\Z|\w)|(?<![*#/])[*#/]++(?=\s|\Z)")
#: Characters that comment marks are made of, at either end of a line.
_LINE_MARKS = " \t\f*#/;%>|!<-"
_SPACES = re.compile(r"\s+")
#: What follows an address on its line begins anew.
_ADDRESS = re.compile(r"(https?://\S+) ")


def normalised(line: str) -> str:
    """Lower case, single blanks, no quotes, comment marks or list numbers in brackets."""
    return _SPACES.sub(" ", _MARKS.sub(" ", _LINE_OPENS.sub("", _QUOTES.sub("", line.lower()).lstrip(_LINE_MARKS).rstrip(_LINE_MARKS)))).strip()


def _sentences_of(text: str) -> Iterator[str]:
    """Sentences of normalised lines; an empty line, or one of marks only, ends a sentence too."""
    held: list[str] = []
    for line in [*text.splitlines(), ""]:
        plain = normalised(line)
        if plain:
            held.append(_ADDRESS.sub(r"\1\n", plain))
        elif held:
            yield from _STOP.split("\n".join(held))
            held = []


def sentences(text: str) -> list[tuple[str, dict[str, str]]]:
    """Identifiers of the known licence sentences of a text, in order, with what they name."""
    lowered = text.lower()
    if not any(hint in lowered for hint in HINTS):
        return []
    found = []
    for sentence in _sentences_of(text):
        after = 0
        for begin in _BEGIN.finditer(sentence):
            at = begin.end()
            if at < after or not _OPENS.match(sentence, at):
                continue
            for name, known in _KNOWN:
                if hit := known.match(sentence, at):
                    found.append((name, {k: v for k, v in hit.groupdict().items() if v}))
                    after = hit.end()
                    break
    return found


def licences(found: list[tuple[str, dict[str, str]]]) -> list[str]:
    """The licences that a sequence of identifiers names, each once, by the ordered rules.

    Sentences that no rule takes give ``Unknown``.
    """
    names, used, out = [name for name, _ in found], [False] * len(found), []
    for licence, steps in RULES:
        for at in range(len(names) - len(steps) + 1):
            span = range(at, at + len(steps))
            if names[at : at + len(steps)] == steps and not any(used[i] for i in span):
                said = {"v": "", "kind": ""} | {k: v for i in span for k, v in found[i][1].items()}
                out.append((at, licence.format(v=said["v"], kind=said["kind"].upper()).rstrip("-")))
                for i in span:
                    used[i] = True
    out += [(at, "Unknown") for at, taken in enumerate(used) if not taken]
    return list(dict.fromkeys(licence for _, licence in sorted(out)))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licences, licensed`` of every row.

    ``sentence_ids`` and ``licences`` are joined by commas in the order of the text. A null or
    empty text has none of either, and is not ``licensed``. Repeated rows come out as often as
    they came in.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [sentences(text or "") for text in column(part, "text").to_pylist()]
                named = [licences(each) for each in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id").cast(pa.int64()),
                        pa.array([len(each) for each in found], pa.int64()),
                        pa.array([",".join(name for name, _ in each) for each in found], pa.string()),
                        pa.array([",".join(each) for each in named], pa.string()),
                        pa.array([bool(each) for each in named], pa.bool_()),
                    ],
                    ["doc_id", "n_sentences", "sentence_ids", "licences", "licensed"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(each, "doc_id bigint, n_sentences bigint, sentence_ids string, licences string, licensed boolean")
