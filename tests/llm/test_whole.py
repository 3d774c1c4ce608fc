"""Cases in which the corpus operators once did less than the whole job."""

import random
import textwrap

import numpy as np

from wordmill.llm import decontaminate, licences, pii


def leaks(spark, items, texts):
    """Items found in each text, with their similarity to three places."""
    known = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {x["item"]: round(x["similarity"], 3) for x in r["leaks"]} for r in decontaminate.mark(docs, known).collect()}
    return [got[i] for i in range(len(texts))]


def test_decontaminate_rows_shorter_than_the_item(spark):
    rng = random.Random(8)
    item = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    few = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    texts = [item[:30] + item[31:], item[3:], item[:-3], item[:40], few[:-1], few[:4], item[:56] + ["x", "y"]]
    got = leaks(spark, [(1, " ".join(item)), (2, " ".join(few))], [" ".join(x) for x in texts])
    assert got == [{1: 0.85}, {1: 0.946}, {1: 0.946}, {}, {2: 0.833}, {}, {1: 0.897}]


def test_decontaminate_fingerprints_follow_the_weights():
    """96 shingles of which ten items hold each, one of them replaced by one that no item holds: similarity 0.896."""
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(200):
        shingles = rng.integers(1, 2**63, 97, dtype=np.uint64)
        item, window = shingles[None, :96], shingles[None, 1:]
        made = decontaminate.prints(item, np.full((1, 96), 0.1)) ^ decontaminate.prints(window, np.r_[np.full(95, 0.1), 1.0][None])
        missed += int(decontaminate.BITS[made].sum()) > decontaminate.RADIUS
    assert missed <= 2


def test_decontaminate_items_that_share_their_shingles(spark):
    """Ten items with the same 100 words before a word of their own."""
    rng = random.Random(4)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    items = [(i, " ".join([*shared, f"own{i}"])) for i in range(10)]
    got = leaks(spark, items, [" ".join(["a", "b", *shared, "other", "c"])])
    assert set(got[0]) == set(range(10))


def test_decontaminate_does_not_depend_on_passes(spark, monkeypatch):
    """Equal items, items that differ in one word and one alone, in one pass and in several."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    alone, equal, base = fresh(60), fresh(60), fresh(60)
    near = [[*base[:i], *fresh(1), *base[i + 1 :]] for i in (5, 20, 40, 50)]
    items = [(1, alone), (2, equal), (3, [w.upper() for w in equal]), *enumerate([base, *near], 4)]
    items = [(i, " ".join(x)) for i, x in items]
    changed = [" ".join([*x[:30], "other", *x[31:]]) for x in (alone, equal, base)]
    one = leaks(spark, items, changed)
    assert one[0] == {1: 0.836} and one[1] == {2: 0.836, 3: 0.836} and 4 in one[2]
    for most in (1, 2, 4):
        monkeypatch.setattr(decontaminate, "ITEMS", most)
        assert leaks(spark, items, changed) == one


def test_decontaminate_changed_word_among_shared_ones(spark):
    rng = random.Random(7)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    items = [(i, " ".join([*shared, f"own{i}"])) for i in range(10)]
    assert 3 in leaks(spark, items, [" ".join([*shared[:50], "other", *shared[51:], "own3"])])[0]


MIT = [
    "Copyright (c) 2020 Some Body",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the Some Body Institute nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "    http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
GPL = [
    "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.",
]


def test_licences_full_notices(spark):
    """The notices as they are published: one paragraph a line, wrapped, and wrapped in comments."""
    gpl2, gpl3 = [x.format(";", ";", 2) for x in GPL], [x.format(":", ",", 3) for x in GPL]
    want, texts = [], []
    for name, notice in (("MIT", MIT), ("BSD-3-Clause", BSD), ("BSD-2-Clause", [*BSD[:3], BSD[4]]), ("Apache-2.0", APACHE), ("GPL-2.0-or-later", gpl2), ("GPL-3.0-or-later", gpl3)):
        lines = "\n\n".join(textwrap.fill(x, 66) for x in notice)
        for text in ("\n\n".join(notice), lines, textwrap.indent(lines, "# ", lambda _: True), "/*\n" + textwrap.indent(lines, " * ", lambda _: True) + "\n */\nint main;"):
            texts.append(f"Some prose.\n{text}\nMore prose.")
            want.append((name, 0))
    texts += ["This is not released under the\nMIT License of old", "\ue000licenmit-grant", "licensed\n" * 20_000]
    want += [("", 1), ("", 1), ("", 20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licences"], r["n_unknown"]) for r in licences.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pii_iban_before_other_codes(spark):
    """Capitals, digits and other ibans after or before a valid one do not hide it."""
    a, b = "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"
    texts = [a + " BIC COBADEFFXXX", "DE89370400440532013000 EUR 500", f"{b} {a}, {b}", f"Ref AB12 {a} 17", "DE88 3704 0044 0532 0130 00 EUR", f"x{b}", f"é {b}7 {a}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if "iban" in x] for r in pii.report(docs).collect()}
    span = lambda *found: [f"iban:{n}:{n + len(x)}" for x, n in found]
    assert got == {
        0: span((a, 0)), 1: ["iban:0:22"], 2: span((b, 0), (a, 23), (b, 52)), 3: span((a, 9)), 4: [], 5: [], 6: span((a, 26)),
    }
    assert pii.redact(docs).first()["text"] == "<iban> BIC COBADEFFXXX"
