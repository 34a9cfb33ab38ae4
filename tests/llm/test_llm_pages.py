"""URL filters, HTML extraction, licence scans and toxicity."""

import random
import time

import numpy as np
import pytest
from llm_fixtures import docs, texts
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField(c, t) for c, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()),
                                                      ("host", T.StringType()), ("text", T.StringType()), ("rule", T.StringType()))])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "r") for r in rows], PAGE)


# --- URL filters ----------------------------------------------------------

URLS = ["http://example.net/", "https://a.example.net/en/1?x", "https://a.example.net/enx/1", "http://EXAMPLE.NET/en/", "http://net/x", "http://x.internet/y",
        "http://b.example.com/de/5", "http://b.example.com/DE/5", "http://xexample.com/de/5", "http://foo.org/fr/", "http://foo.org/en/", "http://foo.net",
        "http://foo.net?q=/", "foo.net/bar", "", None, "://", "http://", "http://casino-win.example.com/en/", "http://my-adult.site/x", "http://badults.site/x",
        "http://a.net://b/en/", "http://user@x.net:80/p", "http://ads.example.net/en/3", "http://é.net/en/", "http://x.net/é\nb", "http://spam.org/fr/x#y"]


def _judge(url):
    import re
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)), m.group(2)) if m else ("", "")
    fit = [(len(r), r, v) for v, r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
           for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    bad = re.search(r"(^|[.\-])(adult|porn|casino|bets|pills|spam|ads|warez)([.\-]|$)", host)
    return host, path, None, "block" if bad else "allow"


def test_url_filter(spark):
    from riskframe.llm import urls
    d = pages(spark, [(i, u, None) for i, u in enumerate(URLS + URLS[:5])])
    got = urls.judge(d, urls.rule_table(spark, urls.RULES), keep=["page_id"]).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: _judge(u) for i, u in enumerate(URLS + URLS[:5])}
    assert len(got) == len(URLS) + 5
    p = urls.judge(d, urls.rule_table(spark, urls.RULES), keep=["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p


def test_url_rules_without_tokens_and_empty_tables(spark):
    from riskframe.llm import urls
    d = pages(spark, [(1, "http://a.b/123456", None), (2, "http://a.b/x", None)])
    long = urls.Rule("digits", r"/[0-9]{5,}", (), "block")
    assert {r.page_id: r.verdict for r in urls.judge(d, urls.rule_table(spark, [long]), keep=["page_id"]).collect()} == {1: "block", 2: "allow"}
    assert {r.verdict for r in urls.judge(d, urls.rule_table(spark, []), keep=["page_id"]).collect()} == {"allow"}
    assert urls.judge(pages(spark, []), urls.rule_table(spark, urls.RULES), keep=["page_id"]).count() == 0


# --- HTML -----------------------------------------------------------------

FRAME = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';if(a<b)x();</script></head><body class='x'>"
         "<header><h1>Site</h1></header><nav><ul><li><a href='/a'>A</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><!-- c > -->"
         "{main}<aside>More</aside><div id='comments'><p>First!</p></div><form><label>Mail</label></form><footer>&copy; me</footer></body></html>")


@pytest.mark.parametrize("main,want", [
    ("<article><h1>Head &amp; tail</h1><p>One\n  two<p>three <b>bo</b>ld &lt;x&gt; &#233;&eacute;</p></article>", "Head & tail\nOne two\nthree bold <x> éé"),
    ("<article><p><b>a<br><p>b</article>", "a\nb"),
    ("<article><header><h1>H</h1></header><p>x</p><div class='ad'>buy</div><section class=\"comments\"><p>no</p></section><p>y</p><footer>f</footer></article>", "H\nx\ny"),
    ("<main><p>in main</p></main>", "in main"),
    ("<div class='post-content'><p>body text of a post</p></div>", "body text of a post"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><pre> k  v </pre></article>", "1\n2\na\nb\nk v"),
    ("<article><p title='a>b'>q</p><p data-x=\"<p>\">r</p><script>z</script>s</article>", "q\nr\ns"),
    ("<article></article>", ""),
])
def test_extract_markup(main, want):
    from riskframe.llm import html
    assert html.extract(FRAME.format(main=main), None) == want


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<article><p>cut off he", "cut off he"), ("<article><p>x</p><!-- never ends", "x"),
    ("<article>a < b and c > d &am", "a < b and c > d &am"), ("<article>x<script>never ends", "x"), ("</p></div>text", "text"), ("<html><body></body></html>", "")])
def test_extract_odd_pages(page, want):
    from riskframe.llm import html
    assert html.extract(page, None) == want


def test_template_over_hosts(spark):
    """Pages without an article: the host's constant text runs are template."""
    from riskframe.llm import html
    page = "<html><body><div><p>Welcome to our site</p></div><div><p>{}</p><p>{}</p></div><div><p>Call us now</p></div></body></html>"
    rows = [(i, f"http://plain.example/{i}", page.format(f"story {i} begins", f"and ends {i * 7}")) for i in range(8)]
    rows += [(20 + i, f"http://art.example/{i}", FRAME.format(main="<article><p>Same text on all pages</p></article>")) for i in range(6)]
    rows += [(40, None, None), (41, "http://one.example/", page.format("a", "b")), (42, "http://art.example/x", "<p>no frame</p>"), (20, "http://art.example/0", rows[8][2])]
    got = {r.page_id: r.text for r in html.extract_pages(pages(spark, rows)).collect()}
    for i in range(8):
        assert got[i] == f"story {i} begins\nand ends {i * 7}"
        if i < 6:
            assert got[20 + i] == "Same text on all pages"
    assert got[40] == "" and got[41] == "Welcome to our site\na\nb\nCall us now" and got[42] == "no frame"
    assert html.extract_pages(pages(spark, rows)).count() == len(rows)
    assert html.extract_pages(pages(spark, [])).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    """A page that fills most of its host's rows keeps its text, also with other markup around it."""
    from riskframe.llm import html
    page = "<html><body data-v='{}'><div><p>Welcome to our site</p></div><div><p>{}</p><p>{}</p></div></body></html>"
    rows = [(i, "http://copies.example/", page.format(i % 2, "one story", "told again")) for i in range(9)]
    rows += [(20 + i, "http://copies.example/", page.format(0, f"story {i}", f"end {i}")) for i in range(4)]
    rows += [(40 + i, "http://one.example/", page.format(i, "one story", "told again")) for i in range(4)]
    got = {r.page_id: r.text for r in html.extract_pages(pages(spark, rows)).collect()}
    assert {got[i] for i in range(9)} == {"one story\ntold again"} and [got[20 + i] for i in range(4)] == [f"story {i}\nend {i}" for i in range(4)]
    assert {got[40 + i] for i in range(4)} == {"Welcome to our site\none story\ntold again"}
    # no page loses all of its runs
    found, runs = html.tokens(rows[0][2])
    assert runs and html.extract(rows[0][2], html.own_main(found), frozenset(runs)) == "Welcome to our site\none story\ntold again"


@pytest.mark.parametrize("name", ["post-title", "entry-date", "article-title", "story", "text-muted"])
def test_named_element_without_the_text_is_no_main_slot(spark, name):
    from riskframe.llm import html
    page = lambda *t: FRAME.format(main="<p>Skip to here</p><div class='wrap'><h1 class='%s'>%s</h1><p>%s</p><p>%s</p></div>" % (name, *t))
    text = "A title", "The first paragraph holds much more text than the title", "and so does the second one"
    assert html.extract(page(*text), None) == "\n".join(text)
    rows = [(i, "http://named.example/", page(f"Title {i}", f"paragraph {i} of some length", f"and the end of it {i}")) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract_pages(pages(spark, rows)).collect()}
    assert got == {i: f"Title {i}\nparagraph {i} of some length\nand the end of it {i}" for i in range(6)}


def test_deep_and_long_pages():
    from riskframe.llm import html
    deep = "<div>" * 3000 + "<article><p>deep</p></article>"
    assert html.extract(deep, None) == "deep"
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    assert html.extract(long, None).count("\n") == 19_999


BODY = "<h1>Head line</h1><p>First paragraph of the article, long enough to be the text.</p><p>Second one &amp; more of the text that readers came for.</p>"
BODY_TEXT = "Head line\nFirst paragraph of the article, long enough to be the text.\nSecond one & more of the text that readers came for."
SIDE = "<div class='sidebar'>Links</div>"


@pytest.mark.parametrize("page", [
    f"<body>{SIDE}<article class='post open-comments'>{BODY}</article></body>", f"<body><article class='post has-share'>{BODY}</article></body>",
    f"<body><article class='post category-alert'>{BODY}</article>{SIDE}</body>", f"<body><div class='site sidebar-right'>{SIDE}<article>{BODY}</article></div></body>",
    f"<body><div class='form-page'>{BODY}</div>{SIDE}</body>", f"<body><div class='form-page'><main>{BODY}</main></div></body>",
    f"<body><div class='post open-comments'>{BODY}{SIDE}</div></body>",
    f"<body><div class='entry'>{BODY}</div><div id='comments'><p>me too, I say so</p></div></body>",
    f"<body><article>{BODY}</article><div id='comments'><p>{'a long comment that outweighs the article ' * 20}</p></div></body>"])
def test_class_names_do_not_drop_the_text(spark, page):
    from riskframe.llm import html
    got = html.extract_pages(pages(spark, [(1, "http://a.b/x", page)])).collect()
    assert [r.text for r in got] == [BODY_TEXT]


@pytest.mark.parametrize("name,page", [
    ("open tags", lambda n: "<a " * n), ("open quotes", lambda n: "<a '" * n), ("quoted ends", lambda n: "<a '>' " * n + '"'), ("mixed quotes", lambda n: "<a \"'" * n + ">"),
    ("nested", lambda n: "<div>x" * n), ("nested content", lambda n: "<div class=content>x" * n), ("spans and rules", lambda n: "<span>" * n + "<hr>" * n),
    ("end tags", lambda n: "<i>" * n + "</b>" * n), ("comments", lambda n: "<!-- " * n), ("attribute", lambda n: "<p " + "a" * 8 * n + ">x"),
    ("attributes", lambda n: "<p " + "a=1 " * n + ">x"), ("ends", lambda n: "<" * 8 * n), ("items", lambda n: "<ul><li>" * n + "<li>x" * n)])
def test_hostile_pages_are_read_in_linear_time(name, page):
    from riskframe.llm import html

    def seconds(n):
        began = time.process_time()
        html.extract(page(n), 12345)
        return time.process_time() - began

    assert seconds(16_000) < 0.5 + 10 * seconds(4_000)              # four times the page; by the square it would be sixteen times
    assert html.extract("<p>Text " + page(50), None) is not None


# --- licences -------------------------------------------------------------

def test_license_scan(spark):
    from riskframe.llm import licenses
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. "
           "Some other sentence. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
           "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.")
    rows = [(1, "Some text.\n// Licensed under the Apache License, Version 2.0.\nMore.", "s"), (2, "Licensed under CC BY-NC 4.0. All rights reserved.", "s"),
            (3, mit, "s"), (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "s"),
            (5, "This work is licensed under the GNU General Public License, version 3. Nothing licensed under the MIT license here.", "s"), (6, None, "s"), (7, "", "s"),
            (8, "x " * 50_000 + "\nReleased under the MIT License.", "s"), (1, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "s")]
    got = sorted((r.doc_id, r.licenses, r.unmatched) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == [(1, ["Apache-2.0"], []), (1, ["MPL-2.0"], []), (2, ["CC-BY-NC-4.0", "Proprietary"], []), (3, ["MIT"], []), (4, [], ["mit-grant"]),
                   (5, ["GPL-3"], []), (6, [], []), (7, [], []), (8, ["MIT"], [])]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_rules_are_ordered():
    from riskframe.llm.licenses import match_rules
    seq = [(0, "bsd-grant", ""), (1, "bsd-source", ""), (2, "bsd-binary", ""), (4, "bsd-endorse", ""), (9, "apache-ref", "2.0"), (20, "apache-comply", "")]
    assert match_rules(seq) == ([("BSD-3-Clause", 0, 4), ("Apache-2.0", 9, 9)], ["apache-comply"])
    assert match_rules(seq[:3])[0] == [("BSD-2-Clause", 0, 2)]


def test_license_sentences_run_over_wrapped_lines(spark):
    from riskframe.llm import licenses
    rows = [(1, "Prose without an end\nLicensed under the Apache License,\nVersion 2.0.\nMore.", "s"),
            (2, "/*\n * Licensed under the\n * Apache License, Version\n * 2.0.\n */\nint x;", "s"),
            (3, ";; This work is licensed under the GNU General\n;; Public License, version 3.", "s"),
            (4, "# Released under\n#\n# the MIT License.", "s"), (5, "Title\nAll Rights\r\nReserved\nTitle", "s"),
            (6, "x. Released under the MIT License\nand other terms. Licensed under the\n\nMIT License", "s"),
            (7, "1) All rights reserved\n2) Released under the\n   MIT License; all rights\n reserved", "s")]
    got = sorted((r.doc_id, r.licenses, [tuple(s) for s in r.spans]) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == [(1, ["Apache-2.0"], [(1, 1)]), (2, ["Apache-2.0"], [(0, 0)]), (3, ["GPL-3"], [(0, 0)]), (4, [], []), (5, ["Proprietary"], [(1, 1)]),
                   (6, ["MIT"], [(1, 1)]), (7, ["Proprietary", "MIT", "Proprietary"], [(0, 0), (1, 1), (2, 2)])]


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """// Copyright 2008 Some Firm Inc.
//
// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//     * Redistributions of source code must retain the above copyright
// notice, this list of conditions and the following disclaimer.
//     * Redistributions in binary form must reproduce the above
// copyright notice, this list of conditions and the following disclaimer
// in the documentation and/or other materials provided with the
// distribution.
{endorse}//
// THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
// "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
// LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
// A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
// OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
// SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
// LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
// DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
// THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
// (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
// OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ENDORSE = """//     * Neither the name of {x} nor the names of its
// contributors may be used to endorse or promote products derived from
// this software without specific prior written permission.
"""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
"""
GPL = """    This program is free software{sep} you can redistribute it and/or modify
    it under the terms of the GNU {kind} as published by
    the Free Software Foundation{sep2} either version {v} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {kind} for more details.
"""


@pytest.mark.parametrize("text,want", [
    (MIT, ["MIT"]), (MIT.replace("\n", "\r\n"), ["MIT"]), (BSD.format(endorse=""), ["BSD-2-Clause"]),
    (BSD.format(endorse=ENDORSE.format(x="the copyright holder")), ["BSD-3-Clause"]), (BSD.format(endorse=ENDORSE.format(x="Some Firm Inc.")), ["BSD-3-Clause"]),
    (APACHE, ["Apache-2.0"]), (APACHE.replace("Licensed", "The ASF licenses this file to You").replace("Version 2.0 (the", "Version 2.0\n * (the"), ["Apache-2.0"]),
    (GPL.format(sep=":", sep2=",", kind="General Public License", v=3), ["GPL-3"]), (GPL.format(sep=";", sep2=";", kind="General Public License", v=2), ["GPL-2"]),
    (GPL.format(sep=":", sep2=",", kind="Lesser General Public License", v="2.1"), ["LGPL-2.1"]),
    (GPL.format(sep=":", sep2=",", kind="Affero General Public License", v=3), ["AGPL-3"]),
    ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"])])
def test_whole_license_notices(spark, text, want):
    from riskframe.llm import licenses
    r, = licenses.scan(docs(spark, [(1, "int main()\n" + text + "\nint x;", "s")])).collect()
    assert r.licenses == want and r.unmatched == []


# --- toxicity -------------------------------------------------------------

def test_toxicity_held_out(spark):
    """Held-out accuracy on a seeded table with groups of copies, long texts and words
    that both classes share: half of the labels train."""
    from riskframe.llm import toxicity
    rng = random.Random(11)
    plain = [f"{a}{b}" for a in ("mor", "tel", "fan", "gri", "sol", "bek", "ula", "pre", "dit", "von") for b in ("", "a", "en", "ish", "ter", "os", "ly", "ume")]
    foul = [f"{a}{b}" for a in ("zark", "blorg", "vexil", "snarv", "kludd") for b in ("", "s", "ing", "er")]
    rows = []
    for i in range(6000):
        w = [rng.choice(plain) for _ in range(2_000 if i % 400 == 0 else rng.randrange(20, 90))]
        bad = i % 12 == 0
        for _ in range(rng.randrange(2, 7) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(foul)
        rows.append((i, " ".join(w), int(bad)))
    rows += [(6000 + i, rows[1][1], 0) for i in range(900)] + [(7000 + i, rows[12][1], 1) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(2))).cache()
    lab = d.select("doc_id", "toxic", "half")
    model = toxicity.fit(d, lab.where("half = 0").select("doc_id", "toxic"), max_labelled=6000)
    assert model.thresholds[0] < model.thresholds[1]
    s = toxicity.score(d.where("half = 1"), model, keep=["doc_id", "toxic"]).groupBy("toxic").agg(F.avg((F.col("p_toxic") >= 0.5).cast("int")).alias("r"), F.avg("severity").alias("s")).collect()
    rate = {r.toxic: r.r for r in s}
    sev = {r.toxic: r.s for r in s}
    assert rate[1] > 0.95 and rate[0] < 0.005 and sev[1] > 1 > sev[0]


def test_ordinal_solver_orders_grades():
    from riskframe.llm import toxicity
    rng = np.random.default_rng(0)
    cols = [sorted(set(rng.integers(0, 12, rng.integers(0, 8)).tolist())) for _ in range(2000)]
    score = np.array([sum(1 for c in x if c < 4) for x in cols])
    grades = (score >= 1).astype(int) + (score >= 3)
    w, t = toxicity.solve(cols, grades, 12)
    assert t[0] < t[1] and w[:4].min() > w[4:].max() + 1
    p = np.array([[1 / (1 + np.exp(k - w[x].sum())) for k in t] for x in cols])
    assert ((p >= 0.5).sum(axis=1) == grades).mean() > 0.97


def test_toxicity_defined_cases(spark):
    from riskframe.llm import toxicity
    rows = texts(5, 12)
    d = docs(spark, rows)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    none = labels.where("toxic > 5")
    assert toxicity.reject(d, none).count() == len(rows)
    assert toxicity.reject(d, labels).columns == d.columns
    assert toxicity.reject(docs(spark, []), labels).count() == 0
    assert toxicity.score(d, toxicity.fit(d, labels)).count() == len(rows)
