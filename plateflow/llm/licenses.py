"""Operator 9: license scans by template-markup matching.

Templates are word sequences with optional regions, <<opt>> ... <</opt>>, and replaceable ones: <<var:n>> (up to n words of
any kind), <<num:n>> (up to n words of digits), <<unless:a,b>> at the end (not if one of these words follows). Each compiles into
an automaton over words; a text is accepted where the mandatory wording stands word for word in order. Licenses are whole
texts, so a changed condition is no match; notices and tags are templates of their own. The automata run as state sets from the
places where a template's first words occur, so most texts cost one search for a few words. Base phrases alone count in n_base.

Nulls and empty texts have no words and no labels. Rows that share a doc_id are scanned each for itself. An empty table gives
an empty result. Texts are scanned whole, whatever their length. A label that several templates give counts once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import LOWER_BYTES, as_bytes, per_row
from plateflow.llm.common import documents

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that the contract names, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licenses, lower case, words only, with markup.
_MIT_END = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>> 1 <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>> 2 <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAME = "<<opt>> 3 <</opt>> neither the name of <<var:12>> nor the names of <<var:4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC_END = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation"
_CC = "<<num:2>> <<opt>> international <</opt>> <<opt>> unported <</opt>> <<opt>> generic <</opt>> <<opt>> public <</opt>> license"
TEMPLATES = [
    # Whole licenses.
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <</opt>> shall be included in all copies or substantial portions of the software " + _MIT_END),
    ("bsd-2-clause", f"{_BSD_HEAD} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_HEAD} {_BSD_NAME} {_BSD_END}"),
    ("isc", "permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies " + _ISC_END),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted " + _ISC_END),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>> 1 <</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<opt>> 2 <</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<opt>> 3 <</opt>> this notice may not be removed or altered from any source distribution"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    # Notices, as files carry them.
    ("mit", "<<opt>> released <</opt>> <<opt>> licensed <</opt>> under the mit license"),
    ("apache-2", "licensed under the apache license version 2 <<opt>> 0 <</opt>> the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache license version 2 <<opt>> 0 <</opt>>"),
    ("gpl", _GNU.format("").replace("  ", " ") + " <<opt>> either <</opt>> version <<num:1>> of the license"),
    ("lgpl", _GNU.format("lesser") + " <<opt>> either <</opt>> version <<num:2>> of the license"),
    ("agpl", _GNU.format("affero") + " <<opt>> either <</opt>> version <<num:1>> of the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license <<opt>> v <</opt>> 2 0"),
    # Tags.
    ("mit", "spdx license identifier mit <<unless:0,advertising,cmu,enna,feh,festival,khronos,modern,open,wu>>"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl", "spdx license identifier gpl <<num:2>>"),
    ("lgpl", "spdx license identifier lgpl <<num:2>>"),
    ("agpl", "spdx license identifier agpl <<num:2>>"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("epl-2", "spdx license identifier epl 2 0"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause <<unless:darwin,first,freebsd,netbsd,patent,pkgconf,views>>"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause <<unless:acpica,attribution,clear,flex,hp,lbnl,modification,no,open,sun,tso>>"),
    ("isc", "spdx license identifier isc <<unless:veillard>>"),
    ("0bsd", "spdx license identifier 0bsd"),
    ("zlib", "spdx license identifier zlib <<unless:acknowledgement>>"),
    ("bsl-1", "spdx license identifier bsl 1 0"),
    ("unlicense", "spdx license identifier unlicense <<unless:libtelnet,libwhirlpool>>"),
    ("cc0", "spdx license identifier cc0 1 0"),
    # Names with a version.
    *((label, f"gnu {name}general public license {version}") for label, name in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero ")) for version in ("v2", "v3", "version 2", "version 3")),
    ("lgpl", "gnu lesser general public license v2 1"),
    *(("cc-by", f"creative commons attribution {version}") for version in ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by", f"creative commons attribution {_CC}"),
    ("cc-by", "cc by <<unless:nc,nd,sa>>"),
    ("cc-by-sa", f"creative commons attribution share alike {_CC}"),
    ("cc-by-sa", f"creative commons attribution sharealike {_CC}"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", f"creative commons attribution noderivatives {_CC}"),
    ("cc-by-nd", f"creative commons attribution noderivs {_CC}"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nc", f"creative commons attribution noncommercial {_CC}"),
    ("cc-by-nc", f"creative commons attribution non commercial {_CC}"),
    ("cc-by-nc", "cc by nc <<unless:nd,sa>>"),
    ("cc-by-nc-sa", f"creative commons attribution noncommercial sharealike {_CC}"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-nc-nd", f"creative commons attribution noncommercial noderivatives {_CC}"),
    ("cc-by-nc-nd", f"creative commons attribution noncommercial noderivs {_CC}"),
    ("cc-by-nc-nd", "cc by nc nd"),
    ("cc0", "cc0 1 0 universal"),
]
#: Stands in an automaton for any word, and for a word of digits.
ANY, NUMBER = None, 0


class Automaton:
    """States are places in the template. A word moves a state on by its edge; optional regions and spent wildcards are jumps."""

    def __init__(self, template: str):
        self.words: list[bytes | int | None] = []
        self.jumps: dict[int, list[int]] = {}
        self.unless: frozenset[bytes] = frozenset()
        opened = None
        for x in re.findall(r"<<.*?>>|\S+", template):
            if x == "<<opt>>":
                opened = len(self.words)
            elif x == "<</opt>>":
                self.jumps.setdefault(opened, []).append(len(self.words))
                opened = None
            elif x.startswith(("<<var:", "<<num:")):
                at, n = len(self.words), int(x[6:-2])
                self.words += [ANY if x[2] == "v" else NUMBER] * n
                for i in range(at, at + n):
                    self.jumps.setdefault(i, []).append(at + n)
            elif x.startswith("<<unless:"):
                self.unless = frozenset(x[9:-2].encode().split(b","))
            else:
                self.words.append(x.encode())
        self.end = len(self.words)
        self.first = self.closure({0})
        #: Words that a match can begin with.
        self.begins = {self.words[s] for s in self.first if s < self.end}
        in_option = {i for a, bs in self.jumps.items() for b in bs for i in range(a, b)}
        self.mandatory = {w for i, w in enumerate(self.words) if isinstance(w, bytes) and i not in in_option}

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.jumps.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[bytes], at: int) -> bool:
        """Whether the template stands in words from at on. Takes as many words as it has places at most."""
        states = self.first
        for i in range(at, min(at + self.end, len(words)) + 1):
            if self.end in states and (i == len(words) or words[i] not in self.unless):
                return True
            if not states or i == len(words):
                break
            w = words[i]
            states = self.closure({s + 1 for s in states if s < self.end and ((x := self.words[s]) is ANY or x == w or x is NUMBER and w.isdigit())})
        return False


class Scanner:
    def __init__(self) -> None:
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
        self.templates = [(Automaton(t), label) for label, t in TEMPLATES]
        #: A text without any of these strings has no match: each template and phrase has at least one.
        self.hint = re.compile(rb"licen[cs]e|software|redistribution|source|cc|creative", re.I)

    def scan(self, text: bytes | None) -> tuple:
        low = (text or b"").translate(LOWER_BYTES)
        words = WORD.findall(low)
        if not self.hint.search(low):
            return len(words), 0, None, None, "", "", 0.0
        places, base = [], set()
        for phrase, label in self.phrases:
            n, at = len(phrase), -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + n] == phrase:
                    places.append(at)
                    base.add(label)
        labels, longest = set(base), 4 if base else 0
        there = set(words)
        starts: dict[bytes, list[int]] = {}
        live = [(a, label) for a, label in self.templates if a.mandatory <= there]
        for w in {b for a, _ in live for b in a.begins}:
            starts[w] = [i for i, x in enumerate(words) if x == w]
        for a, label in live:
            if any(a.match(words, i) for w in a.begins for i in starts[w]):
                labels.add(label)
                longest = max(longest, len(a.mandatory))
        # Sure of long wording, less so of a short phrase.
        score = min(1.0, 0.5 + longest / 20) if labels else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def license_scan(docs: DataFrame) -> DataFrame:
    rows = as_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(per_row(SCAN, ("doc_id",), lambda: Scanner().scan), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
