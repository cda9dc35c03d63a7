import random
import re

import pytest

from millrace.llm import licenses as lc

FEW = {"mit": ["released under the mit license"], "cc": ["licensed under cc by nc 4 0"], "short": ["abc def"]}


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def distance_anywhere(notice, text):
    """Least edits between a notice and any part of a text, by the full table."""
    row = [0] * (len(text) + 1)
    for a in notice:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def damaged(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("xyzé") + text[at:], text[:at] + "q" + text[at + 1 :]])
    return text


def made_up(seed, n):
    rng, out = random.Random(seed), []
    fill = ["the", "Mit", "license", "License,", "é", "under", "released", "cc by", "abc", "def", "...", "general public", "\n", "Licensed"]
    for _ in range(n):
        parts = rng.choices(fill, k=rng.randint(0, 15))
        for _ in range(rng.randint(0, 2)):
            notice = rng.choice([x for some in FEW.values() for x in some])
            parts.insert(rng.randint(0, len(parts)), damaged(rng, notice, rng.randint(0, 4)).upper())
        out.append(rng.choice([" ", "  ", "-"]).join(parts))
    return out


def test_finds_all_within_the_errors_and_no_others():
    finder = lc.Finder(FEW)
    for text in made_up(1, 400):
        words = f" {' '.join(plain(text))} "
        found = finder(words)
        for n, (_, notice) in enumerate(finder.notices):
            least, own = distance_anywhere(notice, words), [f for f in found if f[0] == n]
            assert bool(own) == (least <= finder.errors[n]), (notice, words)
            if own:
                assert min(f[3] for f in own) == least
            for _, s, e, errors in own:
                assert distance_anywhere(notice, words[s:e]) == errors
            assert all(a[2] <= b[1] for a, b in zip(own, own[1:], strict=False))


def test_pieces_cover_a_notice():
    for size in range(1, 40):
        for k in range(min(size, 6)):
            text = "".join(chr(97 + i % 26) for i in range(size))
            cut = lc.pieces(text, k)
            assert "".join(p for _, p in cut) == text and len(cut) == k + 1 and all(text[s:].startswith(p) and p for s, p in cut)


def base_by_hand(text):
    words, out = plain(text), []
    for phrase, label in lc.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), out


def test_rows_and_places(spark):
    texts = [*made_up(2, 150), None, "", "MIT License mit license", "general public license. Apache\nLICENSE", "x\x00mit_license", "permit license", "Émit license mit license", "Mİt license"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "The MIT license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 as id", "2 as n_words", "3 as matches", "4 as label")
    got = sorted(lc.scan_licenses(df, notices=FEW).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(want)
    finder = lc.Finder(FEW)
    for r, (key, text) in zip(got, want, strict=True):
        n, places = base_by_hand(text)
        starts = [p for p, _ in places]
        assert (r.doc_id, r.n_words, r.n_base) == (key, n, len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == sorted({x for _, x in places})
        for m in r.matches:
            assert text[m.start : m.end] == m.found and len(plain(m.found)) == m.n_words
            assert plain(text)[m.first_word : m.first_word + m.n_words] == plain(m.found)
        near = {label for label, some in FEW.items() for x in some if distance_anywhere(f" {x} ", f" {' '.join(plain(text))} ") <= max(1, len(x) // lc.CHARS_AN_ERROR)}
        assert {m.label for m in r.matches} == near
        assert finder is not None


@pytest.mark.parametrize("label", sorted(lc.NOTICES))
def test_notices_survive_damage(label):
    rng, finder = random.Random(label), lc.Finder(lc.NOTICES)
    for notice in lc.NOTICES[label]:
        k = max(1, len(notice) // lc.CHARS_AN_ERROR)
        for edits in range(k + 1):
            text = f" some words {' '.join(damaged(rng, notice, edits).split())} and more "
            assert label in {finder.notices[n][0] for n, *_ in finder(text)}


def test_names_of_other_licenses_are_not_taken_for_one():
    finder = lc.Finder(lc.NOTICES)
    for label, text in [("mit", "released under the bsd license"), ("bsd", "released under the mit license"), ("cc-by-nc", "licensed under cc by sa 4 0"), ("lgpl", "gnu affero general public license"), ("apache", "subject to the terms of the mozilla public license")]:
        assert label not in {finder.notices[n][0] for n, *_ in finder(f" {text} ")}


def test_long_text_of_seeds_and_empty_table(spark):
    text = "released under the m " * 50_000 + "released under the mit licence"
    (r,) = lc.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.n_words == 200_005 and [m.label for m in r.matches] == ["mit"] and r.matches[0].end == len(text)
    assert lc.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark):
    from millrace.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    notices = [(label, f" {x} ") for label, some in lc.NOTICES.items() for x in some]
    got = QUERIES["op11_license_scan"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        n, places = base_by_hand(texts[r.doc_id])
        base = {x for _, x in places}
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted(base)))
        if r.n_words < 400:  # the full table takes the product of both lengths
            words = f" {' '.join(plain(texts[r.doc_id]))} "
            least = [(label, distance_anywhere(x, words), len(x) - 2) for label, x in notices]
            near = [(label, 1 - d / size) for label, d, size in least if d <= max(1, size // lc.CHARS_AN_ERROR)]
            assert r.labels == ",".join(sorted(base | {label for label, _ in near}))
            assert r.score == pytest.approx(1.0 if base else max((s for _, s in near), default=0.0))
