import random

from gridmill.llm import chat, entries, licenses


def turns(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "pair_id long, turn long, role string, text string, prompt_turns int, prompt string")


def render(pairs):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in pairs)


def brute(c, r):
    n = 0
    while n < min(len(c), len(r)) and [(x or "") for x in c[n]] == [(x or "") for x in r[n]]:
        n += 1
    return n, render(c[:n]), render(c[n:]), render(r[n:])


def test_preferences_equal_brute_force(spark):
    long_ = "word " * 200_000
    chosen = {
        1: [("user", "hi"), ("assistant", "a"), ("user", "more"), ("assistant", "good")], 2: [("user", "q"), ("assistant", "same")], 3: [("user", "x")],
        4: [(None, None), ("assistant", "ü🙂")], 5: [("user", long_), ("assistant", long_)], 6: [("assistant", "only here")], 8: [("user", "")],
    }
    rejected = {
        1: [("user", "hi"), ("assistant", "a"), ("user", "more"), ("assistant", "bad"), ("user", "why")], 2: [("user", "q"), ("assistant", "same")], 3: [("user", "y")],
        4: [("", ""), ("assistant", None)], 5: [("user", long_), ("assistant", "short")], 7: [("assistant", "only there")], 8: [("user", ""), ("user", "")],
    }
    sides = [turns(spark, [(i, n, *t) for i, ts in s.items() for n, t in enumerate(ts)] + [(None, 0, "user", "no pair")]).repartition(3) for s in (chosen, rejected)]
    got = {r.pair_id: r for r in chat.preferences(*sides).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 8]
    for i, r in got.items():
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == brute(chosen[i], rejected[i]), i
        for text, mask, ts in ((r.chosen, r.chosen_mask, chosen[i]), (r.rejected, r.rejected_mask, rejected[i])):
            whole, at = r.prompt + text, len(r.prompt)
            for s in mask:
                assert s.start == at
                at += s.length
            assert at == len(whole)
            learned = "".join(whole[s.start : s.start + s.length] for s in mask if s.learned)
            assert learned == "".join(f"{t or ''}<|im_end|>\n" for role, t in ts[r.prompt_turns :] if role == "assistant")
    empty = turns(spark, [])
    assert chat.preferences(empty, empty).count() == 0
    # ties and repeated rows have an order of their own
    tied = turns(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "z"), (1, 0, "user", "a")])
    assert chat.preferences(tied, tied).first().prompt == render([("user", "z"), ("user", "a"), ("user", "a"), ("user", "b")])


def test_plans_have_no_python(spark, sf):
    for f in (entries.op2_chat_preferences, entries.op8_licenses):
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def files(spark, rows):
    return spark.createDataFrame([(p, t, "x", 3) for p, t in rows], "path string, text string, license string, similarity int")


def notice(name, k):
    return [text for n, text in licenses.NOTICES if n == name][k]


def test_licenses(spark):
    prose = "some words about the weather and the sea " * 40
    mit, gpl = notice("MIT", 0), notice("GPL-3.0", 0)
    rows = [
        ("LICENSE", gpl), ("a/LICENSE", f"Copyright\n{mit}"), ("a/b/c/x.py", prose), ("a/b/y.py", f"{prose}\nReleased under the MIT license!\n{prose}"), ("z.py", prose), ("d/z.py", None), ("d/e.py", ""),
        (None, prose), (None, mit), (None, None), ("q/one", mit), ("q/two", gpl), ("q/three", prose), ("a/b/c/x.py", prose), ("r/s", "Licensed " * 100_000), ("ab/x", prose), ("r/t", f"this is not released under any license that we know of {mit}"),
    ]
    got = [tuple(r) for r in licenses.scan(files(spark, rows)).collect()]
    assert len(got) == len(rows)
    by = {r[0]: (r[1], r[3], r[4]) for r in got}
    assert by["LICENSE"] == ("GPL-3.0", "own", None) and by["a/LICENSE"] == ("MIT", "own", None) and by["a/b/y.py"] == ("MIT", "own", None)
    assert by["a/b/c/x.py"] == ("MIT", "inherited", "a") and by["z.py"] == ("GPL-3.0", "inherited", "") and by["ab/x"] == ("GPL-3.0", "inherited", "")
    assert by["d/z.py"] == ("GPL-3.0", "inherited", "") and by["q/three"][1:] == ("inherited", "q") and by[None] == (None, "none", None)
    assert by["r/s"][1] == "inherited" and by["r/t"][1] == "inherited"
    assert licenses.scan(files(spark, [])).count() == 0


def test_short_wrapped_and_commented_notices(spark):
    def wrapped(text, mark, width=9):
        words = text.split()
        return "\n".join(f"{mark} " + " ".join(words[i : i + width]) for i in range(0, len(words), width))

    paragraphs = lambda name: [t for n, t in licenses.NOTICES if n == name and len(t.split()) >= licenses.PARAGRAPH]
    code = "\nimport os\n\ndef f(x):\n    return os.path.join(x, 'y')\n" * 30
    rows = {
        "1": ("CC BY-NC 4.0", "CC-BY-NC-4.0"), "2": ("Redistribution and use in source and binary forms are permitted.", "BSD-3-Clause"), "3": ("Apache, Version 2.0", "Apache-2.0"),
        "4": ("All rights reserved.", "Proprietary"), "5": ("Licensed under the MIT License.", "MIT"), "6": ("No part may be reproduced without", "Proprietary"),
        "7": ("This Source Code Form is subject to the terms of the Mozilla", "MPL-2.0"), "8": ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), "9": ("Creative CC BY 4.0 Attribution 4.0 International", "CC-BY-4.0"),
        "10": ("/*\n" + wrapped(paragraphs("MPL-2.0")[0], " *") + "\n */" + code, "MPL-2.0"),
        "11": ("\n#\n".join(wrapped(t, "#") for t in paragraphs("Apache-2.0")) + "\n" + code, "Apache-2.0"),
        "12": ("Copyright 2020 Some One\n\n" + "\n\n".join(wrapped(t, "") for t in paragraphs("MIT")), "MIT"),
        "13": ("\n\n".join(wrapped(t, "//", 5) for t in paragraphs("GPL-3.0")) + code, "GPL-3.0"), "14": (code, None), "15": ("the sea and the software of the wind", None),
    }
    got = {r.path: r.license for r in licenses.notices(files(spark, [(p, t) for p, (t, _) in rows.items()])).collect()}
    assert got == {p: name for p, (_, name) in rows.items() if name}


def test_the_prefilter_loses_no_unit(spark):
    rng = random.Random(5)
    terms = sorted({w for _, line in licenses.NOTICES for w in line.split()}) + ["sea", "wind", "sky"]
    rows = [(f"{i}/f", "\n".join(" ".join(rng.choices(rng.choice(licenses.NOTICES)[1].split(), k=rng.randrange(1, 9)) + rng.choices(terms, k=rng.randrange(4))) for _ in range(rng.randrange(1, 3)))) for i in range(400)]
    kept = [tuple(r) for r in licenses.notices(files(spark, rows)).select("path", "license", "similarity").orderBy("path").collect()]
    whole = [tuple(r) for r in licenses.notices(files(spark, rows), least=0.0).where(f"similarity >= {licenses.LEAST}").select("path", "license", "similarity").orderBy("path").collect()]
    assert kept == whole and 50 < len(kept) < 400
