import datetime as dt

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.sources import records as R

GOOD = ["1", "SERVICE_01", "VALIDATED", "29/02/24 10:15:30", "123456789", "5", "", "", "", "31/12/21 23:59:59", "1", "TEL12345678", "", "",
        *[""] * 11, "7"]
EDGES = {
    3: ["30/02/21 00:00:00", "29/02/23 00:00:00", "01/13/21 00:00:00", "01/01/21 24:00:00", "1/01/21 00:00:00", "01/01/21 00:00:60", "31/04/21 00:00:00", "", "00/01/21 00:00:00"],
    0: ["", "12a", "١٢", " 1", "00012", "9" * 40], 5: ["", "1.", ".5", "1.5", "1e5", "-1", "0x1F", "1,5"], 4: ["", "1234567890", "+5"],
    1: ["SERVICE_13", "service_01", "SERVICE_00", "SERVICE_12"], 11: ["", "TEL1234567", "TEL123456789", "tel12345678"], 12: ["TEL00000000", "TEL 0000000"],
    25: ["", "x", "12"], 14: ["a,b", 'say "x"', "two\nlines", "تسوية", "a" * 100_000],
}


def line(values, quote=()):
    return ",".join('"' + v.replace('"', '""') + '"' if i in quote or any(c in v for c in ',"\n\r') else v for i, v in enumerate(values))


def strict(text):
    try:
        return R.parse_strictly(text), None
    except R.Failure as f:
        return None, f.reason


def both(lines):
    good, strictly, bad, _ = R.bisect(pa.array(lines, pa.string()), 8)
    loaded = sorted([*[i for a, b, _ in good for i in range(a, b)], *[i for i, _ in strictly]])
    for i, reason in bad:
        assert strict(lines[i])[1] == reason
    assert all(strict(lines[i])[1] is None for i in loaded)
    assert sorted([*loaded, *[i for i, _ in bad]]) == list(range(len(lines)))
    return loaded


def variants():
    out = [line(GOOD), None, "", ",", "," * 25, "," * 40, line(GOOD) + ",,,,", line(GOOD) + ",,,,,", line(GOOD) + ",,x", line(GOOD) + ',""', line(GOOD[:-1]),
           line(GOOD, quote=range(26)), line(GOOD) + "\n", line(GOOD).replace("VALIDATED", '"VALIDATED'), line(GOOD).replace("VALIDATED", 'VALI"DATED'),
           line(GOOD).replace("VALIDATED", '"VALIDATED" '), line(GOOD).replace(",", "\t"), line(GOOD) + "\r"]
    for p, values in EDGES.items():
        for v in values:
            out += [line([*GOOD[:p], v, *GOOD[p + 1:]]), line([*GOOD[:p], v, *GOOD[p + 1:]], quote=[p])]
    return out


def test_fast_and_strict_paths_agree():
    lines = variants()
    good = both(lines)
    assert 0 in good and 1 not in good
    at, typed = R.parse_block(pa.array(lines))
    assert sorted(at.tolist()) == good
    for col, name in zip(typed, R.NAMES):
        assert len(col) == len(good), name


def test_each_variant_alone_and_among_good_ones():
    for x in variants():
        both([x])
        both([line(GOOD)] * 3 + [x] + [line(GOOD)] * 3)


def test_clean_blocks_are_parsed_once_and_failures_cost_halvings():
    clean = pa.array([line(GOOD)] * 4096)
    good, strictly, bad, parses = R.bisect(clean, 1024)
    assert (len(good), len(strictly), len(bad), parses) == (4, 0, 0, 4)
    for failures in (1, 2, 8):
        rows = [line(GOOD)] * 4096
        for k in range(failures):
            rows[500 * k + 7] = "bad"
        good, strictly, bad, parses = R.bisect(pa.array(rows), 1024)
        assert [i for i, _ in bad] == [500 * k + 7 for k in range(failures)]
        assert len(strictly) <= (R.LEAF - 1) * failures and 4 < parses <= 4 + 2 * 7 * failures


def test_records_that_only_together_look_right():
    half = line(GOOD)[:len(line(GOOD)) // 2]
    both(['1,"', '",' + line(GOOD), line(GOOD) + "\n" + line(GOOD), line(GOOD), half + '"', '"' + half, "\ufeff" + line(GOOD), line(GOOD)[1:] + "\n1"] * 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(variants()), st.text(alphabet='",\n0a', max_size=60),
                          st.tuples(st.integers(0, 25), st.text(alphabet='0123456789/: "\n,TEL', max_size=20)).map(lambda x: line([*GOOD[:x[0]], x[1], *GOOD[x[0] + 1:]]))), max_size=40))
def test_any_mix_of_records(lines):
    both(lines)


def test_split_record():
    assert R.split_record('a,"b,""c""",,"x\ny"') == ["a", 'b,"c"', "", "x\ny"]


def test_typed_values(spark):
    df = spark.createDataFrame([(1, line(GOOD), "k"), (2, line([*GOOD[:14], 'q "z", end', *GOOD[15:]]), "k"), (3, "bad", "k"), (None, line(GOOD), None), (4, None, None)],
                               "id bigint, line string, reason string")
    ok = {r.id: r for r in R.load_records(df, "line", ["id"]).collect()}
    assert set(ok) == {1, 2, None}
    assert ok[1].transaction_date__date_part == dt.datetime(2024, 2, 29, 10, 15, 30, 123456) and ok[1].transaction_date__fraction_ns == 123456789
    assert ok[1].request_date__date_part is None and ok[1].unclear_position_25 == 7 and ok[1].transaction_fees is None and ok[2].destination_type == 'q "z", end'
    failed = {r.id: r.reason for r in R.failed_records(df.drop("reason"), "line", ["id"]).collect()}
    assert failed == {3: "1 values", 4: "no record"}
    assert R.failed_records(df.limit(0).drop("reason"), "line", ["id"]).count() == 0
    assert R.load_records(df.limit(0), "line", ["id"]).count() == 0


def test_reasons():
    assert strict(line([*GOOD[:3], "31/02/21 00:00:00", *GOOD[4:]]))[1] == "no real date in transaction_date__date_part"
    assert strict(line(GOOD) + ",,x")[1] == "value at position 27, after the last column"
    assert strict('1,"x')[1] == "broken quoting"
