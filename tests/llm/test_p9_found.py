"""Cut texts: hot template families, and texts cut after a closing sign."""

from __future__ import annotations

import random

from compare import session

from graphloom.llm.truncation import cut_texts, ending, goes_on


def found(rows):
    docs = session().createDataFrame(rows, "doc_id long, source string, text string")
    return {r.doc_id: r.reason for r in cut_texts(docs).collect()}


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(7))


def test_continuation_within_a_hot_template():
    r = random.Random(5)
    shared = " ".join(word(r) for _ in range(200))
    rows, cut = [], []
    for i in range(400):
        own = [word(r) for _ in range(r.randint(6, 12))]
        rows.append((i, "s", f"{shared} {' '.join(own)}."))
        if i % 10 == 0:
            # ends after a full stop that is not the last one: only the continuation tells
            own[3] += ".x"
            rows[-1] = (i, "s", f"{shared} {' '.join(own)}.")
            rows.append((1000 + i, "s", f"{shared} {' '.join(own[:3])} {own[3][:-1]}"))
            cut.append(1000 + i)
    got = found(rows)
    assert sorted(got) == cut
    assert set(got.values()) == {"copy"}


def test_endings():
    assert ending("Steps:\n- [x]") == ending("see `a`") == ending("f(x)") == "sign"
    assert ending('He said "stop."') == ending("(All of it.)") == ending("Done.") == "done"


def test_cut_after_a_closing_sign():
    r = random.Random(6)
    rows = [(i, "pr", " ".join(word(r) for _ in range(40))[:300]) for i in range(4)]
    rows.append((10, "pr", " ".join(word(r) for _ in range(40))[:293] + "x\n- [ ]"))
    # a full copy of a text that stops after a bracket
    body = " ".join(word(r) for _ in range(60)) + " (as it is)"
    rows += [(20, "notes", body), (21, "notes", body + " and then there is more to say about all of it.")]
    # finished texts that end on a sign, at no limit and without a continuation
    rows += [(30, "pr", " ".join(word(r) for _ in range(20)) + " (done)"), (31, "notes", " ".join(word(r) for _ in range(25)) + " `end`")]
    got = found(rows)
    assert got.get(10) == "limit"
    assert got.get(20) == "copy"
    assert not {21, 30, 31} & set(got)


def test_copies_cut_anywhere():
    r = random.Random(9)
    rows, cut = [], []
    for i, share in enumerate((0.9, 0.7, 0.5, 0.2) * 5):
        words = [word(r) for _ in range(100)]
        at = int(100 * share)
        rows.append((i, "s", " ".join(words) + "."))
        # a near-copy: spaces and case differ, and one early word
        begun = [words[0].upper(), "other", *words[2:at]] if share > 0.5 else words[:at]
        rows.append((100 + i, "s", "  ".join(begun) + " " + words[at][:3]))
        cut.append(100 + i)
    got = found(rows)
    assert sorted(got) == cut and set(got.values()) == {"copy"}


def test_odd_texts():
    long = " ".join(f"w{i}" for i in range(30000)) + "."
    rows = [(1, "s", None), (2, "s", ""), (3, None, " \n"), (4, "s", long), (4, "s", long), (5, "s", "."), (None, "s", "lost wor")]
    assert not set(found(rows)) & {1, 2, 3, 4, 5}
    assert found(rows[:0]) == {}


def test_beginnings_of_words_in_a_large_corpus():
    """The same beginning of a word ends many texts, here and there before a mark; more texts may not hide it."""
    r = random.Random(12)
    for times in (1, 20):
        rows, cut = [], []
        for i in range(100 * times):
            rows.append((i, "s", f"{word(r)} {word(r)} takes the integration of {word(r)} {word(r)}."))
        for i in range(6 * times):
            rows.append((10_000 + i, "s", f"{word(r)} {word(r)} takes the {word(r)} integr"))
            cut.append(10_000 + i)
            if i % 6 == 0:
                rows += [(20_000 + i, "s", f"{word(r)} {word(r)} takes the {word(r)} integr [truncated]"), (30_000 + i, "s", f"{word(r)} {word(r)} of the ...")]
                cut += [20_000 + i] + [30_000 + i] * (times > 1)
        # ends many texts and is no beginning of another word
        rows += [(40_000 + i, "s", f"The {word(r)} {word(r)} stores it.\nSigned off by the bot") for i in range(6 * times)]
        # a whole word with longer forms, that ends texts now and then
        rows += [(50_000 + i, "s", f"{word(r)} store the record, record by record, of records and records and records and records {word(r)}.") for i in range(20 * times)]
        rows += [(60_000 + i, "s", f"{word(r)} {word(r)} the record") for i in range(6 * times)]
        # a source each, so that equal lengths tell nothing
        got = found([(i, f"s{i}", text) for i, _, text in rows])
        assert set(cut) <= set(got), times
        assert not {i for i in got if i < 10_000 or i >= 40_000}, times


def test_every_partner_of_a_hot_bucket():
    """The one text that goes on is neither the longest of its bucket nor the shortest that closes alike."""
    r = random.Random(13)
    shared, foot = [" ".join(word(r) for _ in range(n)) for n in (200, 9)]
    rows, cut = [], []
    for i in range(40):
        # a family that begins alike; a word near the end of the copy differs
        own = [word(r) for _ in range(r.randint(12, 20))]
        own[7] += ".x"
        rows.append((i, "s", f"{shared} {' '.join(own)}."))
        rows.append((1000 + i, "s", f"{shared} {' '.join([*own[:2], 'other', *own[3:7]])} {own[7][:-1]}"))
        # texts of one foot that begin apart; a word near the beginning of the copy differs
        own, rest = [word(r) for _ in range(50)], [word(r) for _ in range(r.randint(100, 150))]
        rows.append((2000 + i, "s", f"{' '.join(own)} {foot} end.x {' '.join(rest)}."))
        rows.append((3000 + i, "s", f"{' '.join([*own[:3], 'other', *own[4:]])} {foot} end."))
        cut += [1000 + i, 3000 + i]
    got = found(rows)
    assert sorted(got) == sorted(cut) and set(got.values()) == {"copy"}


def test_alignment_at_any_place():
    words = [f"w{i}" for i in range(100)]
    copy = " ".join(words[:80]) + " a b c en"
    # the same last words come once more, nearer to the place of the copy's end, after other words
    hub = " ".join(["so", "it", "is", "said", *words[:80], "a b c ended", *words[80:]])
    assert goes_on(copy, hub) is True
    assert goes_on(copy, " ".join([*words[:40], *words[60:80], "a b c", "ended", *words[80:]])) is None
    assert goes_on(copy, " ".join([*words[:76], "a b c done", "now", *words[76:80], "a b c ends here."])) is True
