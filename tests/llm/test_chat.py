from millrace.llm.chat import rotate

TURNS = "conv_id bigint, turn bigint, role string, text string, window string"


def brute(rows, size):
    distinct = {(c, t, r if r is not None else "unknown", x or "") for c, t, r, x in rows}
    groups = {}
    for c, t, r, x in distinct:
        groups.setdefault((c, 0 if size is None else None if t is None else t // size), []).append((t, r, x))
    out = []
    for (conv, window), turns in groups.items():
        turns.sort(key=lambda one: (one[0] is not None, one[0] or 0, one[1], one[2]))
        for who in sorted({r for _, r, _ in turns} - {"system"}):
            text, mask = "", []
            for _, r, x in turns:
                name = r.replace("\n", " ").replace("<|", "< |")
                head = "assistant" if r == who else name if r == "system" else f"user name={name}"
                text += f"<|{head}|>\n"
                start = len(text)
                text += x.replace("<|", "< |") + "<|end|>\n"
                if r == who:
                    mask.append((start, len(text)))
            out.append((conv, window, who, len(turns), text, mask))
    return sorted(map(str, out))


def shown(df):
    return sorted(
        str((r.conv_id, r.window, r.perspective, r.n_turns, r.text, [tuple(m) for m in r["mask"]])) for r in df.collect()
    )


def test_rotation_equals_brute_force(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", "yo <|end|> <|assistant|>"), (1, 3, "cid", None),
        (1, 3, "cid", ""), (2, 0, "system", "alone"), (3, 5, None, "who"), (None, None, "ann", "x"), (None, 1, "ann", "y"),
        (4, 0, "a<|b\n", "name"), (4, 0, "ann", "tie"), (4, 0, "ann", "tie"), (5, 0, "u", "long " * 50_000),
        *((6, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(150)),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(3)
    assert shown(rotate(turns)) == brute(rows, None)
    assert shown(rotate(turns, window=64, everyone=False)) == brute(rows, 64)
    assert rotate(turns.limit(0)).collect() == []


def test_crowded_windows_are_split_and_stay_whole(spark):
    rows = [(1, None, f"p{i % 3}", f"text {i}") for i in range(900)]
    got = rotate(spark.createDataFrame([(*r, "x") for r in rows], TURNS), window=64).collect()
    assert max(r.n_turns for r in got) < 2 * 64
    parts = {(r.part, r.n_turns) for r in got}
    assert len({p for p, _ in parts}) == len(parts) and sum(n for _, n in parts) == 900
    said = [r.text[s:e].removesuffix("<|end|>\n") for r in got for s, e in r["mask"]]
    assert sorted(said) == sorted(x for *_, x in rows)


def test_everyone_gets_the_whole_dialogue(spark):
    rows = [(1, t, "ann" if t < 64 and t % 2 else "bob", f"t{t}") for t in range(200)]
    rows += [(None, None, "cid", "x"), (None, 1, "dan", "y"), (2, 0, "eve", "z"), (2, 1, "system", "s")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], TURNS).repartition(3)
    got = {(r.conv_id, r.window, r.perspective): r for r in rotate(turns, window=64).collect()}
    assert set(got) == {(1, w, p) for w in range(4) for p in ("ann", "bob")} | {(2, 0, "eve")} | {
        (None, w, p) for w in (None, 0) for p in ("cid", "dan")
    }
    assert got[1, 3, "ann"]["mask"] == [] and got[1, 3, "ann"].text.count("<|user name=bob|>") == 8
    spoken = {(r.conv_id, r.window, r.perspective) for r in rotate(turns, window=64, everyone=False).collect()}
    assert spoken == {(1, 0, "ann"), *((1, w, "bob") for w in range(4)), (2, 0, "eve"), (None, None, "cid"), (None, 0, "dan")}


def test_parts_of_crowded_windows_follow_one_another(spark):
    tied = [(1, t, "ann", f"t{t:04}") for t in range(64)] + [(1, 63, "bob", "tie")]
    crowd = [(c, t // 5, ("ann", "bob")[t < 150], f"t{t:04}") for c in (2, None) for t in range(300)]
    lone = [(3, None, "ann", f"t{t:04}") for t in range(200)] + [(3, None, "bob", "u")]
    turns = spark.createDataFrame([(*r, "x") for r in tied + crowd + lone], TURNS).repartition(3)
    got = rotate(turns, window=64).collect()
    assert {(r.part, r.n_turns) for r in got if r.conv_id == 1} == {(0, 65)}
    for conv in (2, 3, None):
        want = sorted(
            (r for r in tied + crowd + lone if r[0] == conv), key=lambda r: (r[1] if r[1] is not None else -1, r[2], r[3])
        )
        for who in ("ann", "bob"):
            mine = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: (r.window or 0, r.part))
            assert len(mine) == len(want) // 64 and all(64 <= r.n_turns < 128 for r in mine)
            texts = "".join(r.text for r in mine).split("<|end|>\n")[:-1]
            assert [t.split("|>\n")[1] for t in texts] == [x for *_, x in want]
            said = [r.text[s:e].removesuffix("<|end|>\n") for r in mine for s, e in r["mask"]]
            assert said == [x for _, _, role, x in want if role == who]


def test_whole_dialogues_and_parts_of_long_ones(spark):
    rows = [(1, t, "ann" if t < 64 and t % 2 else "bob", f"t{t:04}") for t in range(200)]
    rows += [(None, None, "cid", "first"), (None, 1, "dan", "y" * 5_000), (None, 2, "dan", "last"), (2, 0, "eve", "z")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], TURNS).repartition(3)
    whole = {(r.conv_id, r.part, r.perspective): r for r in rotate(turns).collect()}
    assert set(whole) == {(1, 0, "ann"), (1, 0, "bob"), (None, 0, "cid"), (None, 0, "dan"), (2, 0, "eve")}
    assert whole[1, 0, "ann"].n_turns == 200 and len(whole[1, 0, "ann"]["mask"]) == 32
    cut = rotate(turns, part_chars=1_000).collect()
    assert {r.part for r in cut if r.conv_id == 1} == {0, 1, 2, 3, 4}
    for who in ("ann", "bob"):
        mine = sorted((r for r in cut if (r.conv_id, r.perspective) == (1, who)), key=lambda r: r.part)
        assert "".join(r.text for r in mine) == whole[1, 0, who].text
        assert sum(r.n_turns for r in mine) == 200
        said = [r.text[s:e] for r in mine for s, e in r["mask"]]
        assert said == [whole[1, 0, who].text[s:e] for s, e in whole[1, 0, who]["mask"]]
    assert {(r.part, r.n_turns) for r in cut if r.conv_id is None} == {(0, 2), (5, 1)}
