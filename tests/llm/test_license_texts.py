"""Every licence rule on the licence's own wording."""

import textwrap

import pytest

from voxloom.llm import licenses

HOPE = "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
GNU3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n" + HOPE.format("This program")
GNU2 = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; {2}\n\n" + HOPE.format("This program")
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
TEXTS = [
    ("GPL-3.0-or-later", GNU3.format("")),
    ("AGPL-3.0-or-later", GNU3.format("Affero ")),
    ("LGPL-3.0-or-later", GNU3.format("Lesser ")),
    ("GPL-2.0-or-later", GNU2.format("program", "", "either version 2 of the License, or (at your option) any later version.")),
    ("GPL-2.0-only", GNU2.format("program", "", "version 2.")),
    ("LGPL-2.1-or-later", GNU2.format("library", "Lesser ", "either version 2.1 of the License, or (at your option) any later version.")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", ISC.format("")),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0-only", "This project is licensed under the GNU General Public License v3.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Released under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0,MIT", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;"),
    ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */"),
    ("LGPL-2.1-or-later", "# SPDX-License-Identifier: LGPL-2.1+ or what follows"),
    ("BSL-1.0", "An SPDX-License-Identifier: BSL-1.0. Then more."),
    ("", "Version 2 of the licence is out. Version 2."),
]


@pytest.mark.parametrize("wrap", [False, True])
def test_each_licence_by_its_own_words(spark, wrap):
    fold = lambda t: "\n".join(" * " + x if x else "" for p in t.split("\n") for x in textwrap.wrap(p, 60) or [""])
    rows = [(k, fold(t) if wrap and "SPDX" not in t else t) for k, (_, t) in enumerate(TEXTS)]
    got = {r.doc_id: ",".join(r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in TEXTS]


def test_every_rule_can_fire():
    known = set(licenses.SENTENCES.values())
    assert all(x in known for _, ids in licenses.RULES for i in ids for x in i.split())
    assert {name for name, _ in licenses.RULES} - {n for names, _ in TEXTS for n in names.split(",")} <= {"GPL-3.0-only", "AGPL-3.0-only", "LGPL-3.0-only", "LGPL-2.1-only", "EPL-1.0"}
