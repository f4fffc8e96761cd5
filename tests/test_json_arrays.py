import json
import random

import pytest

from lorekeep.sources import json_arrays as J


def things(seed, n):
    rnd = random.Random(seed)
    texts = ["", "plain", 'q"uote', "back\\slash", "\\\\", '\\"', "[{", "]}", ",", "é ü 中", "\\u0041", "a" * 50, '"', "\n\t"]

    def thing(depth):
        kind = rnd.randrange(6 if depth < 3 else 4)
        if kind == 4:
            return [thing(depth + 1) for _ in range(rnd.randrange(4))]
        if kind == 5:
            return {rnd.choice(texts) + str(i): thing(depth + 1) for i in range(rnd.randrange(4))}
        return [rnd.choice(texts), rnd.randrange(99), None, True][kind]

    return [thing(0) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
@pytest.mark.parametrize("seed", range(3))
def test_ranges_of_any_size_yield_each_element_once(tmp_path, seed, size):
    """Without Spark: summaries, their sums, and the elements of each range."""
    want, path = things(seed, 40), tmp_path / "x.json"
    text = json.dumps(want, ensure_ascii=seed == 1, indent=[None, 1, None][seed])
    data = ("﻿ \n" * (seed == 2) + text + " \n").encode()
    path.write_bytes(data)
    got, inside, depth = [], False, 0
    for a in range(0, len(data), size):
        at = J.Range(f"file://{path}", a, min(a + size, len(data)), inside, depth)
        got += [json.loads(x) for x, in J.elements(at)]
        with J._opened(at.path) as file:
            parity, out, within = J.summed(data[a : a + size], J._escaped(file, a))
        depth += within if inside else out
        inside ^= bool(parity)
    assert got == want and depth == 0 and not inside


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_files_and_folders(spark, tmp_path, size):
    want = things(7, 60)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(want[20 * i : 20 * i + 20]))
    (tmp_path / "in" / "_SUCCESS").write_text("")
    (tmp_path / "in" / "empty.json").write_text(" [ ] ")
    key = lambda rows: sorted(json.dumps(x) for x in rows)
    rows = J.read_array(spark, f"{tmp_path}/in", size)
    assert key(json.loads(r.value) for r in rows.collect()) == key(want)
    if size == 50:
        assert rows.rdd.getNumPartitions() > 10
    J.write_array(rows.repartition(4), f"file://{tmp_path}/out")
    assert key(json.loads(r.value) for r in J.read_array(spark, f"{tmp_path}/out", size).collect()) == key(want)
    J.write_array(rows.limit(0), f"file://{tmp_path}/none")
    assert J.read_array(spark, f"{tmp_path}/none").isEmpty()


@pytest.mark.parametrize("text, message", [('{"a": 1}', "no array"), ('[1, [2, "x"', "breaks off"), ('[1, "x]', "breaks off"), ("", "no array")])
def test_what_is_no_array_is_an_error(spark, tmp_path, text, message):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match=message):
        J.read_array(spark, f"{tmp_path}/x.json", 4).collect()
