"""Sentence-rule licence recognition in DataFrame functions only.

A text is cut into sentences, every sentence is normalised and looked up in a
table of known licence sentences, and the sequence of identifiers found is
matched against an ordered list of licence rules: earlier rules take their
sentences away before later ones look.  Wrapped lines, comment signs, list
marks, names of holders and programs and SPDX tags are seen through.  One projection, no shuffle; a text's
sentences never leave its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences and their identifiers, as they are
# written; "X" stands for a holder's or program's name (WILDCARDS).
SENTENCES = {
    "All rights reserved": "AllRights",
    # MIT
    "Released under the MIT License": "MITref",
    "Licensed under the MIT License": "MITref",
    "This project is licensed under the MIT License": "MITref",
    "MIT License": "MITtitle",
    "The MIT License": "MITtitle",
    "The MIT License (MIT)": "MITtitle",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "MITgrant",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "MITgrant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "MITnotice",
    "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software": "MITnotice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED": "MITasis",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "MITasis",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE": "MITliability",
    # ISC
    "ISC License": "ISCtitle",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ZeroBSDgrant",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND X DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS": "ISCasis",
    "IN NO EVENT SHALL X BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE": "ISCliability",
    # BSD
    "BSD 2-Clause License": "BSDtitle",
    "BSD 3-Clause License": "BSDtitle",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDpre",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDsource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDbinary",
    "Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "THIS SOFTWARE IS PROVIDED BY X \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED": "BSDasis",
    "IN NO EVENT SHALL X BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES": "BSDliability",
    "LOSS OF USE, DATA, OR PROFITS": "BSDliability",
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE": "BSDliability",
    # Apache
    "Licensed under the Apache License, Version 2.0": "Apache2ref",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "Apache2ref",
    "You may not use this file except in compliance with the License": "ApacheUse",
    "You may obtain a copy of the License at": "ApacheCopy",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "ApacheCopy",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0": "ApacheCopy",
    "http://www.apache.org/licenses/LICENSE-2.0": "ApacheURL",
    "https://www.apache.org/licenses/LICENSE-2.0": "ApacheURL",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS": "ApacheAsis",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "ApacheAsis",
    "See the License for the specific language governing permissions and limitations under the License": "ApacheSee",
    # GNU
    "This work is licensed under the GNU General Public License version 3": "GPL3ref",
    "This program is licensed under the GNU General Public License version 3": "GPL3ref",
    "This work is licensed under the GNU General Public License version 2": "GPL2ref",
    "This program is licensed under the GNU General Public License version 2": "GPL2ref",
    "This work is licensed under the GNU Lesser General Public License version 3": "LGPL3ref",
    "X is free software": "GNUfree",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "GPLterms",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "GPL3terms",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version": "GPL2terms",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation": "GPL2onlyterms",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation": "GPL3onlyterms",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "LGPLterms",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "LGPL3terms",
    "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "AGPL3terms",
    "Either version 3 of the License, or (at your option) any later version": "GNU3plus",
    "Either version 2 of the License, or (at your option) any later version": "GNU2plus",
    "Either version 2.1 of the License, or (at your option) any later version": "GNU21plus",
    "Version 2 of the License": "GNU2only",
    "Version 3 of the License": "GNU3only",
    "X is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "GNUhope",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "GNUhope",
    "See the GNU General Public License for more details": "GNUsee",
    "See the GNU Lesser General Public License for more details": "GNUsee",
    "See the GNU Affero General Public License for more details": "GNUsee",
    "You should have received a copy of the GNU General Public License along with X": "GNUreceived",
    "You should have received a copy of the GNU Lesser General Public License along with X": "GNUreceived",
    "You should have received a copy of the GNU Affero General Public License along with X": "GNUreceived",
    # Mozilla, Creative Commons, public domain
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "MPL2ref",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/": "MPLcopy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/": "MPLcopy",
    "Licensed under CC BY-NC 4.0": "CCBYNC4ref",
    "Licensed under CC BY-SA 4.0": "CCBYSA4ref",
    "Licensed under CC BY 4.0": "CCBY4ref",
    "Licensed under CC0 1.0": "CC0ref",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "CCBY4ref",
    "This work is licensed under the Creative Commons Attribution 4.0 International License": "CCBY4ref",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CCBYSA4ref",
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License": "CCBYSA4ref",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CCBYNC4ref",
    "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License": "CCBYNC4ref",
    "To the extent possible under law, X has waived all copyright and related or neighboring rights to this work": "CC0ref",
    "This is free and unencumbered software released into the public domain": "Unlicense",
}

# Identifiers that may follow "SPDX-License-Identifier:".
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
        "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0",
        "Unlicense", "Zlib", "MIT OR Apache-2.0", "Apache-2.0 OR MIT"]
# Older forms of them.
SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only",
            "AGPL-3.0": "AGPL-3.0-only"}

#: identifiers that go with a licence but decide nothing: rules look past them
COMPANIONS = {"MITtitle", "MITliability", "ISCtitle", "ISCasis", "ISCliability", "BSDtitle", "BSDasis", "BSDliability", "ApacheURL",
              "ApacheSee", "GNUhope", "GNUsee", "GNUreceived", "MPLcopy"}

# Licence rules in the order in which they are tried.
RULES = [
    ("BSD-3-Clause", ["AllRights", "BSDpre", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-3-Clause", ["BSDpre", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-2-Clause", ["AllRights", "BSDpre", "BSDsource", "BSDbinary"]),
    ("BSD-2-Clause", ["BSDpre", "BSDsource", "BSDbinary"]),
    ("LGPL-3.0-or-later", ["GNUfree", "LGPL3terms"]),
    ("LGPL-3.0-or-later", ["GNUfree", "LGPLterms", "GNU3plus"]),
    ("LGPL-2.1-or-later", ["GNUfree", "LGPLterms", "GNU21plus"]),
    ("AGPL-3.0-or-later", ["GNUfree", "AGPL3terms"]),
    ("GPL-3.0-or-later", ["GNUfree", "GPL3terms"]),
    ("GPL-3.0-or-later", ["GNUfree", "GPLterms", "GNU3plus"]),
    ("GPL-2.0-or-later", ["GNUfree", "GPL2terms"]),
    ("GPL-2.0-or-later", ["GNUfree", "GPLterms", "GNU2plus"]),
    ("GPL-2.0-only", ["GNUfree", "GPLterms", "GNU2only"]),
    ("GPL-3.0-only", ["GNUfree", "GPLterms", "GNU3only"]),
    ("GPL-2.0-only", ["GNUfree", "GPL2onlyterms"]),
    ("GPL-3.0-only", ["GNUfree", "GPL3onlyterms"]),
    ("Apache-2.0", ["Apache2ref", "ApacheUse", "ApacheCopy", "ApacheAsis"]),
    ("MIT", ["MITgrant", "MITnotice", "MITasis"]),
    ("MIT", ["MITgrant", "MITnotice"]),
    ("ISC", ["ISCgrant"]),
    ("0BSD", ["ZeroBSDgrant"]),
    ("Apache-2.0", ["Apache2ref"]),
    ("MIT", ["MITref"]),
    ("GPL-3.0-only", ["GPL3ref"]),
    ("GPL-2.0-only", ["GPL2ref"]),
    ("LGPL-3.0-only", ["LGPL3ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4ref"]),
    ("CC-BY-4.0", ["CCBY4ref"]),
    ("CC0-1.0", ["CC0ref"]),
    ("MPL-2.0", ["MPL2ref"]),
    ("Unlicense", ["Unlicense"]),
    *[(name, [f"SPDX:{name}"]) for name in SPDX],
    ("proprietary", ["AllRights"]),
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: written out before cutting: an SPDX tag's colon, a version's or a company's dot and an open-ended version end no sentence
PLAIN = [("\r\n", "\n"), *[(f"{firm}.{space}", f"{firm}{space}") for firm in ("corp", "inc", "ltd") for space in (" ", "\n")],
         ("spdx-license-identifier:", "spdx-license-identifier "), (" v. ", " v "), (" v.\n", " v\n"), (".0+", ".0-or-later"),
         (".1+", ".1-or-later")]
#: comment signs and quotation marks at the start of a line
COMMENT = r"(?m)^[ \t>]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+)?[ \t]*"
#: a sentence ends at . ; : ! ? before white space, at a blank line and before a list mark
SENTENCE_END = r"[.;:!?][ \t\n]|\n[ \t]*\n|\n\(?[0-9a-z]{1,2}[.)][ \t]|\n[-+•][ \t]"
NOT_WORD = r"[^a-z0-9]+"
#: names in normalised sentences
WILDCARDS = [
    (r"^neither the name of .{1,100}? nor the names of ", "neither the name of x nor the names of "),
    (r"^this software is provided by .{1,100}? as is and any ", "this software is provided by x as is and any "),
    (r"^the software is provided as is and .{1,100}? disclaims all ", "the software is provided as is and x disclaims all "),
    (r"^in no event shall .{1,100}? be liable for any (special direct|direct) ", r"in no event shall x be liable for any \1 "),
    (r"^.{1,60}? is free software$", "x is free software"),
    (r"^.{1,60}? is distributed in the hope ", "x is distributed in the hope "),
    (r" public license along with .{1,60}$", " public license along with x"),
    (r"^to the extent possible under law .{1,100}? ha(?:s|ve) waived all ", "to the extent possible under law x has waived all "),
]
#: every known sentence has one of these words, so texts without any are not cut at all
WORDS = ("licen|rights reserved|granted|copyright|as is|liab|of use|redistribution|redistribute|free software|version|"
         "warranty|creative commons|public domain|software|mpl ")


def normal(sentence: str) -> str:
    """Lower case, words and figures joined by single spaces."""
    return re.sub(NOT_WORD, " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier, SPDX tags included."""
    tags = {f"SPDX-License-Identifier {t}": f"SPDX:{t}" for t in SPDX}
    tags |= {f"SPDX-License-Identifier {old}": f"SPDX:{new}" for old, new in SPDX_OLD.items()}
    return {normal(s): i for s, i in (SENTENCES | tags).items()}


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in text order (array<string>).

    Single line ends do not end a sentence (texts are wrapped); a run of lines
    that is no known sentence as a whole is looked up line by line.
    """
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    for old, new in PLAIN:
        low = F.replace(low, F.lit(old), F.lit(new))
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])

    def look_up(s: Column) -> Column:
        n = F.trim(F.regexp_replace(s, NOT_WORD, " "))
        for pattern, name in WILDCARDS:
            n = F.regexp_replace(n, pattern, name.replace(r"\1", "$1"))
        return F.try_element_at(known, n)

    def of_sentence(s: Column) -> Column:
        whole = look_up(s)
        lines = F.filter(F.transform(F.split(s, "\n"), look_up), lambda i: i.isNotNull())
        return F.when(whole.isNotNull(), F.array(whole)).when(s.contains("\n"), lines).otherwise(F.array().cast("array<string>"))

    sentences = F.filter(F.split(F.regexp_replace(low, COMMENT, ""), SENTENCE_END), lambda s: s.rlike(WORDS))
    return F.when(low.rlike(WORDS), F.flatten(F.transform(sentences, of_sentence))).otherwise(F.array().cast("array<string>"))


def apply_rules(ids: Column) -> Column:
    """Struct (rest, found): rules tried in order over an identifier sequence.

    A rule matches its identifiers side by side in the sequence of known
    sentences without the companions; what it matched is taken out (a bar keeps
    the two sides apart).
    """
    deciding = F.filter(ids, lambda i: ~i.isin(*sorted(COMPANIONS)))
    sequence = F.concat_ws("", F.transform(deciding, lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in seq)).alias("pattern"))
                      for name, seq in RULES])

    def step(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc["rest"], rule["pattern"], F.lit("|"))
        lost = F.length(acc["rest"]) - F.length(rest)
        times = (lost / (F.length(rule["pattern"]) - 1)).cast("int")
        return F.struct(rest.alias("rest"),
                        F.concat(acc["found"], F.array_repeat(rule["name"], times)).alias("found"))

    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(rules, start, step)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: which licences its sentences declare.

    doc_id, n_sentences (known licence sentences), sentence_ids (comma joined, in
    text order), licenses (comma joined, in rule order, one entry a match),
    n_licenses, n_unmatched (known sentences but companions that no rule took).

    Edge cases: NULL and empty texts give zero counts and empty strings; a
    repeated licence counts each time; repeated rows each get their row; an
    empty table gives an empty result; only ``doc_id`` and ``text`` are read.
    """
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    ruled = found.select("doc_id", "ids", apply_rules(F.col("ids")).alias("out"))
    opened = F.regexp_replace(F.col("out.rest"), "[^<]", "")
    return ruled.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"),
        F.concat_ws(",", "ids").alias("sentence_ids"), F.concat_ws(",", "out.found").alias("licenses"),
        F.size("out.found").cast("long").alias("n_licenses"), F.length(opened).cast("long").alias("n_unmatched"))
