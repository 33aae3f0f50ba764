import time

import numpy as np

from tarn.llm import license_scan as ls
from tarn.llm import license_texts
from tarn.llm.license_texts import TEMPLATES
from tests.llm.conftest import ODD

MIT = dict((n, t) for n, _, t in TEMPLATES)["mit"]


def plain_local_alignment(a, b):
    """Best local score without a band."""
    best = 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_lines_and_edited_texts_are_found_with_their_spans(as_docs):
    edited = MIT.replace("sublicense", "resell and sublicense").replace("merge, ", "")
    texts = {1: "Some words. Released under the MIT License. More words", 2: f"Ünïcödé 😀 head.\n{edited}\ntail", 3: "released under a permit", 4: f"{MIT} {MIT}", 5: MIT[:200]}
    got = ls.license_matches(as_docs([(i, t, None, None) for i, t in texts.items()])).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.template) for r in got] == [(1, "mit-line"), (2, "mit"), (4, "mit"), (4, "mit")]
    assert texts[1][got[0].start : got[0].stop] == "Released under the MIT License" and got[0].coverage == 1
    body = texts[2][got[1].start : got[1].stop]
    assert body.startswith("Permission is hereby") and body.endswith("IN THE SOFTWARE") and 0.97 < got[1].coverage < 1


def test_every_template_is_found_whole():
    index = ls.build()
    for k, (_, _, text) in enumerate(TEMPLATES):
        found = ls.scan(index, f"before it {text} after it", 0.8, 8)
        assert [(f[0], f[2]) for f in found] == [(k, 1.0)]


def test_banded_alignment_equals_the_plain_one_near_its_diagonal():
    rng = np.random.default_rng(5)
    for _ in range(30):
        b = rng.integers(1, 30, 25)
        a = np.concatenate([rng.integers(1, 30, 4), np.delete(b, rng.integers(0, 25, 2)), rng.integers(1, 30, 3)])
        matched, first, last = ls.align(a, b, 4, 40)
        assert 0 <= first < last <= len(a)
        score = plain_local_alignment(a.tolist(), b.tolist())
        assert plain_local_alignment(a[first:last].tolist(), b.tolist()) == score and 2 * matched >= score


def test_insertions_and_close_licenses():
    index, texts = ls.build(), {n: t for n, _, t in TEMPLATES}
    half = MIT.split()
    parted = " ".join([*half[:80], *(f"x{i}" for i in range(40)), *half[80:]])
    named = lambda t: [(index.names[f[0]], index.licenses[f[0]]) for f in ls.scan(index, t, 0.8, 8)]
    assert named(parted) == [("mit", "MIT")]
    assert named(texts["bsd-2-clause"].replace("THIS SOFTWARE IS", "3. Neither the name of Foo nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS")) == [("bsd-3-clause", "BSD-3-Clause")]
    gpl3 = texts["gpl-3.0-notice"]
    assert named(gpl3.replace("General", "Affero General")) == [("agpl-3.0-notice", "AGPL-3.0-or-later")]
    assert named(gpl3.replace("version 3", "version 2")) == [("gpl-2.0-notice-url", "GPL-2.0-or-later")]
    assert named(gpl3.replace("General", "Lesser General")) == [("lgpl-3.0-notice", "LGPL-3.0-or-later")]


def test_winnowing_keeps_a_print_in_each_window():
    hashes = np.random.default_rng(1).integers(0, 1 << 60, 200, dtype=np.uint64)
    picked = sorted(ls.winnow(hashes, 5))
    assert max(np.diff([-1, *picked, 200])) <= 5 and ls.winnow(hashes[:0], 5) == [] and len(ls.winnow(hashes[:2], 5)) == 1


def test_odd_rows(as_docs):
    assert ls.license_matches(as_docs(ODD, "template", "start")).collect() == []
    assert ls.license_matches(as_docs([])).collect() == []


def _named(index, text):
    return [(index.names[f[0]], index.licenses[f[0]]) for f in ls.scan(index, text, 0.8, 8)]


def test_siblings_are_told_apart_or_left_alone():
    index = ls.build()
    of = lambda text: [license for _, license in _named(index, text)]
    line = "This work is licensed under the GNU {} Public License, version {}."
    assert of(line.format("General", "3")) == ["GPL-3.0"] and of(line.format("Affero General", "3")) == ["AGPL-3.0"]
    assert of(line.format("Lesser General", "3")) == ["LGPL-3.0"] and of(line.format("General", "3.1")) == []
    for clause in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        assert of(f"Licensed under CC {clause} 4.0.") == [f"CC-{clause}-4.0"]
    assert of("Licensed under the Apache License, Version 2.1") == [] and of("Licensed under CC BY-XX 4.0.") == []
    assert of("Released under the MIT No Attribution License.") == ["MIT-0"] and of("Released under the Mighty License.") == []
    texts = {n: t for n, _, t in TEMPLATES}
    assert of(texts["agpl-3.0-notice"]) == ["AGPL-3.0-or-later"] and of(texts["bsd-4-clause"]) == ["BSD-4-Clause"] and of(texts["mit-0"]) == ["MIT-0"]
    assert of(texts["apache-2.0-notice"].replace("Version 2.0", "Version 2.1")) == []
    assert of(texts["gpl-3.0-notice"].replace("GNU General", "GNU Affero General").replace("version 3", "version 4")) == []
    assert of(texts["gpl-2.0-only-notice"]) == ["GPL-2.0-only"]
    # a family that has no template of this kind is not taken for its sibling
    assert ls.scan(ls.build([("gpl", "GPL", texts["gpl-3.0-notice"])]), texts["agpl-3.0-notice"], 0.8, 8) == []


def test_whole_legal_texts():
    index = ls.build()
    for name, license, text in license_texts.full_templates()[:1] + license_texts.full_templates()[-1:]:
        words = text.split()
        edited = " ".join(w for k, w in enumerate(words) if k % 40 != 7)
        for shown in (text, edited):
            found = ls.scan(index, f"before it {shown} after it", 0.8, 8)
            assert [(index.names[f[0]], index.licenses[f[0]]) for f in found] == [(name, license)] and found[0][2] > 0.9
    assert len(license_texts.line_templates()) > 1000


def brute_matched(index, terms, template):
    """Matched words of the best local alignment without index, band or window; a line must stand word for word."""
    goal = index.texts[template]
    if template not in index.marks:
        return len(goal) * any((terms[s : s + len(goal)] == goal).all() for s in range(len(terms) - len(goal) + 1))
    pairs = ls.aligned(terms, goal, 0, len(terms) + len(goal))
    return len(pairs) * ls._agrees(index, template, terms, pairs)


def test_scan_equals_brute_force_on_small_texts():
    rng = np.random.default_rng(11)
    chosen = [t for t in TEMPLATES if t[0] in ("mit-line", "apache-line", "mpl-2.0-notice", "isc", "lgpl-3.0-notice", "gpl-3.0-notice", "epl-2.0-notice")]
    index = ls.build(chosen)
    for _ in range(25):
        source = ls.words_of(chosen[rng.integers(len(chosen))][2])
        words = [w for w in source if rng.random() > 0.04]
        for at in sorted(rng.integers(0, len(words) + 1, 2), reverse=True):
            words[at:at] = ["extra"] * int(rng.integers(0, 3))
        text = " ".join(["lead", *words, "tail"])
        terms = np.array([index.terms.get(w, 0) for w in ls.words_of(text)], np.int64)
        matched = {t: brute_matched(index, terms, t) for t in range(len(index.texts))}
        good = {t: m for t, m in matched.items() if m >= 0.8 * len(index.texts[t])}
        found = ls.scan(index, text, 0.8, 8)
        assert len(found) == bool(good)
        if found:
            # the best by matched words less unmatched ones
            assert found[0][0] == min(good, key=lambda t: (len(index.texts[t]) - 2 * good[t], -good[t] / len(index.texts[t]), t))
            assert found[0][1] == good[found[0][0]]


def test_very_long_texts_and_the_contract_query(as_docs, saved, spark):
    long = "word " * 2_000_000 + "Released under the MIT License."
    docs = as_docs([(k, long, None, None) for k in range(3)] + [(9, "x", None, None)])
    got = ls.op4_license_scan(spark, saved(documents=docs)).collect()
    assert [(r.doc_id, r.license, r.start) for r in sorted(got)] == [(k, "MIT", 10_000_000) for k in range(3)]
    assert got[0].text_share == 1 and got[0].stop == len(long) - 1


def _found(index, text):
    return [(index.licenses[f[0]], text[f[3] : f[4]]) for f in ls.scan(index, text, 0.8, 8)]


def test_lines_labels_choices_and_negation():
    index = ls.build()
    cases = {
        "Licensed under the GPLv2+": ["GPL-2.0-or-later"],
        "Released under the GNU General Public License v2 only.": ["GPL-2.0-only"],
        "Dual licensed under the MIT License and the Apache License, Version 2.0": ["MIT", "Apache-2.0"],
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option": ["Apache-2.0", "MIT"],
        "Licensed under the MIT License or, at your option, the Apache License 2.0": ["MIT", "Apache-2.0"],
        "SPDX-License-Identifier: MIT": ["MIT"],
        "// SPDX-License-Identifier: Apache-2.0\n// more": ["Apache-2.0"],
        "# SPDX-License-Identifier: (GPL-2.0+ OR BSD-3-Clause) AND MIT": ["GPL-2.0-or-later", "BSD-3-Clause", "MIT"],
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT": ["GPL-2.0-only", "MIT"],
        "SPDX-License-Identifier: LicenseRef-own": [],
        "SPDX-License-Identifier: MIT-Modern-Variant": [],
        "released under the BSD license": ["BSD"],
        "License: MIT": ["MIT"],
        '{"name": "x", "license": "ISC", "version": "1.0"}': ["ISC"],
        "License: see the file of that name": [],
        "Not licensed under the MIT License": [],
        "It was never publicly released under the MIT License.": [],
        "It isn't licensed under either of Apache License, Version 2.0 or MIT license": [],
        "Released under the GNU General Public License v2.5": [],
        "under either name, the license of the land applies: none": [],
    }
    for text, wanted in cases.items():
        assert [license for license, _ in _found(index, text)] == wanted, text
        assert [license for license, _ in _found(index, f"Words before.\n\n{text}\n\nand 12 words after")] == wanted, text
    assert [span for _, span in _found(index, "Licensed under the GPLv2+ or the MIT License")] == ["Licensed under the GPLv2+", "MIT License"]


def test_labels_are_found_in_documents(as_docs):
    texts = {1: "SPDX-License-Identifier: MIT", 2: "no such thing", 3: "Published under either of Apache-2.0 or MIT", 4: "License: Zlib", 5: "license"}
    got = ls.license_matches(as_docs([(i, t, None, None) for i, t in texts.items()])).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "MIT"), (3, "Apache-2.0"), (3, "MIT"), (4, "Zlib")]


def test_time_of_legal_texts():
    """Inner repeats of legal texts, and many repeats of a title, are not aligned each by itself."""
    index, full = ls.build(), {license: text for _, license, text in license_texts.full_templates()}
    title = "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
    for text, wanted in ((full["GPL-3.0"], ["GPL-3.0"]), (full["GPL-3.0"] + full["Apache-2.0"] + title * 300, ["GPL-3.0", "Apache-2.0"]), (title * 3000, [])):
        began = time.perf_counter()
        assert [index.licenses[f[0]] for f in ls.scan(index, text, 0.8, 8)] == wanted
        assert time.perf_counter() - began < 5  # about one second on an idle machine


def test_parted_copies_of_a_legal_text_are_joined():
    index, text = ls.build(), license_texts.full_templates()[0][2]
    words = text.split()
    parted = " ".join([*words[:700], *(f"x{k}" for k in range(60)), *words[700:]])
    found = ls.scan(index, f"{parted} and {text}", 0.8, 8)
    assert [(index.licenses[f[0]], round(f[2], 2)) for f in found] == [("Apache-2.0", 1.0)] * 2
