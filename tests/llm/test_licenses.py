"""Licence rules: original texts wrapped, unwrapped and commented, SPDX tags, order, edge cases; native plan."""

import re
import textwrap

from llm.conftest import edge_rows, frame

from tracefuse.llm import licenses


def scan(spark, texts, clash=False):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows, clash)).collect()}


MIT = '''MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'''

BSD3 = '''Copyright (c) 2019, The Example Project
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'''

BSD2 = "\n\n".join(p for p in BSD3.replace("All rights reserved.", "").split("\n\n") if not p.startswith("3."))

APACHE = '''Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'''

GPL3 = '''This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'''

GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2").replace("This program", "Foo Tools")
LGPL21 = GPL2.replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
AGPL = GPL3.replace("GNU General", "GNU Affero General")

ISC = '''ISC License

Copyright (c) 2020, A. Person

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'''

MPL = '''This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'''

CC = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."

ORIGINALS = {"MIT": MIT, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3,
             "GPL-2.0-or-later": GPL2, "LGPL-2.1-or-later": LGPL21, "AGPL-3.0-or-later": AGPL, "ISC": ISC, "MPL-2.0": MPL,
             "CC-BY-SA-4.0": CC}


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) if "All rights" not in p else p for p in text.split("\n\n"))


def test_original_texts(lspark):
    cases = []
    for name, text in ORIGINALS.items():
        for width in (60, 72, 80, 10_000):
            body = wrapped(text, width)
            cases += [(name, body), (name, body.replace("\n", "\r\n")), (name, "Prose before.\n\n" + body + "\n\nProse behind.")]
            lines = body.split("\n")
            cases += [(name, "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint main;"),
                      (name, "\n".join(f"# {x}".rstrip() for x in lines)), (name, "\n".join(f"// {x}" for x in lines)),
                      (name, "\n".join(f"    {x}" for x in lines))]
    got = scan(lspark, [t for _, t in cases])
    for i, (name, text) in enumerate(cases):
        assert got[i].licenses == name and got[i].n_unmatched == 0, (name, got[i], text[:300])


def test_spdx_tags(lspark):
    texts = ["SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>",
             "# SPDX-License-Identifier: Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0+ */", "SPDX-License-Identifier: GPL-2.0",
             "<!-- SPDX-License-Identifier: BSD-3-Clause -->", "SPDX-License-Identifier: MIT OR Apache-2.0",
             "SPDX-License-Identifier: NoSuch-1.0", "Copyright 2020 Doe\nSPDX-License-Identifier: MPL-2.0\nAll rights reserved."]
    got = scan(lspark, texts)
    assert [got[i].licenses for i in range(len(texts))] == [
        "MIT", "GPL-2.0-or-later", "Apache-2.0", "GPL-2.0-or-later", "GPL-2.0-only", "BSD-3-Clause", "MIT OR Apache-2.0", "",
        "MPL-2.0,proprietary"]


def test_rules_in_order(lspark):
    bsd = "\n".join(x.strip() for x in BSD2.split("\n\n")[1:4])
    got = scan(lspark, [
        "Released under the MIT License.", "prose\nALL RIGHTS RESERVED.\nReleased under the MIT  license!\nprose",
        GPL3, bsd, bsd.split("\n")[0], "Licensed under the Apache License, Version 2.0.\n" * 3,
        "x Released under the MIT License.", "", None, "a prose line without an end\nReleased under the MIT License"], clash=True)
    assert [got[i].licenses for i in range(10)] == [
        "MIT", "MIT,proprietary", "GPL-3.0-or-later", "BSD-2-Clause", "", "Apache-2.0,Apache-2.0,Apache-2.0", "", "", "", "MIT"]
    assert got[4].n_unmatched == 1 and got[5].n_licenses == 3
    assert got[1].sentence_ids == "AllRights,MITref"


def test_every_sentence_has_a_word_that_lets_it_be_seen():
    assert all(re.search(licenses.WORDS, s) for s in licenses.known_sentences())
    ids = set(licenses.known_sentences().values())
    assert {i for _, seq in licenses.RULES for i in seq} | licenses.COMPANIONS == ids


def test_plan_is_native_and_edges(lspark):
    df = licenses.scan_licenses(frame(lspark, edge_rows()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.count() == len(edge_rows()) and df.filter("n_licenses > 0").count() == 0
    assert licenses.scan_licenses(frame(lspark, []).limit(0)).count() == 0
