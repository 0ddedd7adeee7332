"""Whole notices as licence files and comment headers have them."""

import pytest

from llm_cases import docs
from meterline.llm import licences

MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Redistribution and use are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one."""
WANT = [
    (MIT, "mit-condition@ mit-warranty@", "MIT"), (BSD, "bsd-source@ bsd-binary@", "BSD"),
    (GPL, "gpl-or-later@3 gpl-warranty@", "GPL-3-or-later"),
    (APACHE, "apache-notice@2.0 apache-compliance@ apache-copy@2.0", "Apache-2.0"),
    (APACHE.replace("http:", "https:"), "apache-notice@2.0 apache-compliance@ apache-copy@2.0", "Apache-2.0"),
    (MPL, "mpl-notice@2.0", "MPL-2.0"),
]


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", ";; ", "dnl ", "\t-- ", "! "])
def test_whole_notices(spark, leader):
    rows = [(i, "\n".join(leader + line for line in text.split("\n"))) for i, (text, *_) in enumerate(WANT)]
    rows.append((50, rows[0][1].replace("\n", "\r\n")))
    rows.append((51, "\n".join(leader + line for line in ("Not licensed under the MIT license", "", "Licensed under the", "", "MIT License"))))
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan_licences(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(WANT))] == [w[1:] for w in WANT]
    assert got[50] == WANT[0][1:] and got[51] == ("", "")
