from __future__ import annotations

import re
import textwrap
from collections import Counter

import __spark_entry__ as entries
from ferrylog.llm import licences
from tools.check import compare, connect


def pairs(text):
    words = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))
    return list(zip(words, words[1:], strict=False))


def brute(text):
    """The best window of each template, of all windows."""
    out = {}
    own = pairs(text or "")
    for name, template in licences.TEMPLATES.items():
        marks = Counter(pairs(template))
        if not marks.keys() & set(own):
            continue
        size, best = marks.total(), None
        for start in range(len(own)):
            seen, common = Counter(), 0
            for end in range(start, len(own)):
                seen[own[end]] += 1
                common += seen[own[end]] <= marks[own[end]]
                dice = 2 * common / (end - start + 1 + size)
                if 10 * common >= 4 * (end - start + 1 + size) and (best is None or dice > best[0]):
                    best = (dice, start, end - start + 2)
        if best:
            out[name] = best
    return out


def commented(text, sign, width):
    return "\n".join(sign + line for line in textwrap.wrap(text, width, break_long_words=False))


def texts():
    t = licences.TEMPLATES
    yield from (None, "", "word", "Licensed under", *t.values())
    yield "Some prose. " + t["mit"] + " More prose follows here.\nAnd é more."
    yield "First line\n\n" + t["mit-grant"].replace(", ", ",\n") + "\n \t\nLast."
    yield t["mit-grant"].upper().replace("MERGE, ", "").replace("free of charge", "at no charge")
    yield (t["apache-2.0"] + "\n") * 3 + t["gpl-3.0"].replace("version 3", "version 3 or later")
    yield " ".join(t["isc"].split()[::-1])
    yield "\n".join(f"prose {i} of the license" for i in range(60)) + t["unlicense"]
    yield "/*\n" + commented(t["gpl-3.0-header"], " * ", 40) + "\n *\n" + commented("This program is distributed in the hope that it will be useful.", " * ", 40) + "\n */\nint main;"
    yield commented(t["mit-text"], "# ", 30) + "\nimport os"
    yield "one two three four five six seven eight nine " + t["apache-2.0-header"] + " ten eleven twelve thirteen fourteen fifteen sixteen " + t["isc"][:100]
    yield "the license the license " * 30 + t["mpl-2.0"][:-8]
    yield t["bsd-3-clause-text"].replace("specific prior written", "prior").replace("COPYRIGHT HOLDERS", "REGENTS")


def test_like_brute_force(spark):
    every = list(texts())
    df = spark.createDataFrame([(i, x, 0.5) for i, x in enumerate(every + every)], "doc_id long, text string, dice double")
    have: dict[int, dict] = {}
    for r in licences.licence_matches(df).collect():
        assert r.licence not in have.setdefault(r.doc_id, {})
        have[r.doc_id][r.licence] = (r.dice, r.start, r.words)
    want = [brute(x) for x in every]
    for i, x in enumerate(every + every):
        assert have.get(i, {}) == want[i % len(every)], x


def test_wrapped_commented_and_mid_line_notices_are_found():
    m = licences.Matcher(licences.TEMPLATES)
    for name, text in licences.TEMPLATES.items():
        for form in (commented(text, "// ", 35), commented(text, " * ", 60), f"{'before ' * 40}{text}{' after' * 40}"):
            assert (name, 1.0) in {(f.licence, f.dice) for f in m.found(form)}


def test_very_long_texts():
    m = licences.Matcher(licences.TEMPLATES)
    t = licences.TEMPLATES["gpl-2.0"]
    assert [tuple(f) for f in m.found("filler words " * 400_000 + "\n" + t)] == [("gpl-2.0", 1.0, 800_000, 12), ("gpl-3.0", 20 / 21, 800_000, 11)]
    notices = "Released under the MIT Licence. " * 5000 + licences.TEMPLATES["mit-grant"].replace("merge, ", "") * 500
    found = {f.licence: f for f in m.found(notices)}
    assert found["mit-grant"].start == 25_000 and 0.9 < found["mit-grant"].dice < 1


def test_own_templates_and_empty_table(spark):
    df = spark.createDataFrame([(1, "all rights reserved by nobody"), (None, "all rights reserved by nobody")], "doc_id long, text string")
    have = licences.licence_matches(df, {"mine": "All rights reserved, by nobody!"}).collect()
    assert sorted(map(str, (r.doc_id for r in have))) == ["1", "None"] and {(r.licence, r.dice) for r in have} == {("mine", 1.0)}
    assert licences.licence_matches(df, {}).collect() == []
    assert licences.licence_matches(df.limit(0)).collect() == []


def test_query(spark, folder):
    have = entries.queries()["op3_licence_scans"](spark, folder).toPandas()
    assert compare(have, connect(folder).execute(entries.oracle_sql()["op3_licence_scans"]).df()) is None
    assert len(have)
