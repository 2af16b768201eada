import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lakesmith.functions import dates, demographics, ids, labels, paths, pii, text

ODD_SPACE = "\u2003\xa0\x1c"


def test_text_cleaning(values):
    raw = ["  José   da Silva ", "N/A", "", None, "--", "ok", " none ", f"{ODD_SPACE}a\x1d\t b{ODD_SPACE}"]
    rows = [(v,) for v in raw]
    assert values("v string", rows, text.normalize_text("v")) == [
        "JOSE DA SILVA", None, None, None, None, "OK", None, "A B",
    ]
    assert values("v string", rows, text.null_if_blank("v"))[:6] == [
        "José   da Silva", None, None, None, None, "ok",
    ]
    assert values("v string", rows, text.collapse_spaces("v")) == [
        "José da Silva", "N/A", "", None, "--", "ok", "none", "a b",
    ]
    display = text.normalize_text("v", upper=False, accents=True)
    assert values("v string", [("josé da silva",)], display) == ["josé da silva"]


def test_strip_accents_latin(values):
    pairs = {
        "Ação Straße Ærø Łódź Đỗ": "Acao Strasse AEro Lodz Do",
        "e\u0301": "e",
        "nº 5 – “x” … 3°": 'no 5 - "x" ... 3deg',
        "plain": "plain",
        "日本": "日本",
    }
    got = values("v string", [(k,) for k in pairs], text.strip_accents("v"))
    assert got == list(pairs.values())


def test_whitespace_agrees_with_python_for_every_character(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    raw = [f"{c}a{c}{c} b{c}" for c in chars]
    df = spark.createDataFrame([(r,) for r in raw], "v string").select(
        "v", text.collapse_spaces("v").alias("c"), text.strip("v").alias("s")
    )
    wrong = [
        r.v for r in df.collect() if r.c != re.sub(r"\s+", " ", r.v).strip() or r.s != r.v.strip()
    ]
    assert not wrong, [hex(ord(w[0])) for w in wrong]


def test_digits(values):
    rows = [("123.456.789-09",), ("sem numero",), (None,)]
    assert values("v string", rows, text.digits_only("v")) == ["12345678909", None, None]


def test_cpf(values):
    good = ["529.982.247-25", "52998224725"]
    bad = ["111.111.111-11", "12345678900", "123", None, "", "529982247251"]
    got = values("v string", [(v,) for v in good + bad], ids.validate_cpf("v"), ids.normalize_cpf("v"))
    assert got == [(True, "52998224725")] * 2 + [(False, None)] * 6


def _weighed(digits):
    return sum(int(c) * w for c, w in zip(digits, range(15, 0, -1)))


def _valid_cns(rng):
    """A number built to be valid: its weighed sum of 15 digits is a multiple of 11."""
    while True:
        head = rng.choice("789") + "".join(rng.choices("0123456789", k=13))
        last = -_weighed(head) % 11
        if last < 10:
            return head + str(last)


def test_cns(values):
    good = ["115 4058 8280 0006", "898001160125335"]
    bad = ["123456789012345", "115405882800001", "abc", None]
    got = values("v string", [(v,) for v in good + bad], ids.validate_cns("v"))
    assert got == [True, True, False, False, False, False]

    rng = random.Random(7)
    valid = [_valid_cns(rng) for _ in range(500)]
    broken = []
    for n in valid:
        # Another digit moves the sum off the multiples of 11, but for the place of weight 11.
        at = rng.choice([i for i in range(1, 15) if i != 4])
        broken.append(n[:at] + rng.choice([c for c in "0123456789" if c != n[at]]) + n[at + 1 :])
    first = ["".join(rng.choices("03456", k=1)) + n[1:] for n in valid]
    got = values("v string", [(n,) for n in valid + broken + first], ids.validate_cns("v"))
    assert got == [True] * 500 + [False] * 1000


def test_cnes_and_cid10(values):
    rows = [("12345",), ("123456789",), ("1234567",), (None,), ("x",)]
    assert values("v string", rows, ids.normalize_cnes("v")) == ["0012345", None, "1234567", None, None]
    assert values("v string", rows, ids.validate_cnes("v")) == [False, False, True, False, False]
    codes = [("a09.0",), ("J18",), ("xx",), (None,), ("A0900",)]
    assert values("v string", codes, ids.normalize_cid10("v")) == ["A090", "J18", None, None, None]


DATE_FORMATS = ["%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y", "%Y%m%d", "%d/%m/%y"]
STAMP_FORMATS = [
    "%d/%m/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y %H:%M", "%Y-%m-%d %H:%M",
]


def _first(value, formats):
    for fmt in formats:
        try:
            return dt.datetime.strptime(value.strip(), fmt)
        except ValueError:
            pass
    return None


def _variants(rng, n):
    out = []
    for _ in range(n):
        y, m, d = rng.choice([1, 69, 1968, 1999, 2024, 2025]), rng.randint(0, 13), rng.randint(0, 32)
        h, mi, s = rng.randint(0, 25), rng.randint(0, 61), rng.randint(0, 62)
        p = rng.choice(["", "0", " "])
        day = f"{p}{d}" if d < 10 else str(d)
        mon = f"{rng.choice(['', '0'])}{m}" if m < 10 else str(m)
        year = rng.choice([f"{y:04d}", f"{y % 100:02d}", str(y)])
        sep = rng.choice(["/", "-", ""])
        date = rng.choice([f"{day}{sep}{mon}{sep}{year}", f"{year}{sep}{mon}{sep}{day}"])
        hour = f"{rng.choice(['', '0'])}{h}" if h < 10 else str(h)
        time = rng.choice([
            "", "", f" {hour}:{mi:02d}", f" {hour}:{mi:02d}:{s:02d}", f"T{hour}:{mi:02d}:{s:02d}",
            f"t{hour}:{mi}:{s}", f"T{hour}:{mi:02d}", f"\u2003 {hour}:{mi}",
        ])
        out.append(date + time + rng.choice(["", "", " ", "x"]))
    return out


def test_dates_agree_with_strptime(values):
    raw = _variants(random.Random(11), 6000) + [
        "31/12/2025", "2025-12-31", "20251231", "data ruim", "31/12/99", "31/12/68", "2025123",
        "202511", "20250230", "2025-02-30", "29/02/2024", "2025110", "0000-01-01", "31/12/2025\n",
    ]
    rows = [(v,) for v in raw]
    dates_expected = [r.date() if (r := _first(v, DATE_FORMATS)) else None for v in raw]
    stamps_expected = [_first(v, STAMP_FORMATS + DATE_FORMATS) for v in raw]
    got = values("v string", rows, dates.parse_date_br("v"), dates.parse_timestamp_br("v"))
    wrong = [
        (v, g, (a, b))
        for v, g, a, b in zip(raw, got, dates_expected, stamps_expected)
        if g != (a, b)
    ]
    assert not wrong, wrong[:10]
    assert sum(x is not None for x in dates_expected) > 300
    assert sum(x is not None for x in stamps_expected) > 600


def test_zones(values):
    stamp = dt.datetime(2026, 6, 1, 15)
    assert values("v timestamp_ntz", [(stamp,)], dates.sp_to_utc("v")) == [dt.datetime(2026, 6, 1, 18)]
    assert values("v timestamp_ntz", [(stamp,)], dates.as_sp("v")) == [stamp]
    instant = dt.datetime(2026, 6, 1, 18, tzinfo=dt.timezone.utc)
    assert values("v timestamp", [(instant,)], dates.sp_to_lake_ntz("v")) == [stamp]
    # both sides of a daylight-saving change
    edges = [(dt.datetime(2018, 11, 4, 1, 30),), (dt.datetime(2018, 2, 17, 22, 30),)]
    assert values("v timestamp_ntz", edges, dates.sp_to_utc("v")) == [
        dt.datetime(2018, 11, 4, 3, 30), dt.datetime(2018, 2, 18, 0, 30),
    ]
    start, end = dates.day_window("v", days=2)
    assert values("v timestamp_ntz", [(stamp,)], start, end) == [(dt.datetime(2026, 5, 30, 15), stamp)]


def test_instants_in_the_repeated_hour_of_another_session_zone(spark, values):
    # 05:30 and 06:30 UTC are both 01:30 in New York on this day
    instants = [(dt.datetime(2024, 11, 3, h, 30, tzinfo=dt.timezone.utc),) for h in (5, 6)]
    walls = [dt.datetime(2024, 11, 3, h, 30) for h in (2, 3)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values("v timestamp", instants, dates.as_sp("v", zoned=True)) == walls
        back = dates.as_sp(dates.utc_instant("v"), zoned=True)
        assert values("v timestamp_ntz", [(w,) for w in walls], back) == walls
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_age_bands(values):
    cases = [
        (3, "dia", 0), (20, "dia", 1), (40, "dia", 2), (5, "mes", 2), (0, "ano", 2), (2, "ano", 3),
        (19, "ano", 6), (85, "ano", 13), (None, "ano", 14), (30, "unknown", 14), (79, " ANO ", 12),
        (27, "hora", 1), (6, "minuto", 0), (10, None, 14), (5, "ano", 4), (9, "ano", 5), (29, "ano", 7),
    ]
    got = values("n int, u string", [c[:2] for c in cases], demographics.age_band("n", "u"))
    assert got == [c[2] for c in cases]
    texts = values("n string, u string", [("3.7", "ano"), (" 3 ", "ano")], demographics.age_band("n", "u"))
    assert texts == [14, 4]
    numbers = values("n double, u string", [(3.7, "ano"), (float("nan"), "ano")], demographics.age_band("n", "u"))
    assert numbers == [4, 14]
    assert values("c int", [(13,), (99,), (None,)], demographics.age_band_label("c")) == [
        "80 anos e mais", "Ignorado", "Ignorado",
    ]


def test_hash(values):
    rows = [("abc",), ("  abc ",), (None,), ("   ",)]
    got = values("v string", rows, pii.hash_value("v", "s1"), pii.hash_value("v", "s2"))
    expected = hashlib.sha256(b"s1abc").hexdigest()
    assert [g[0] for g in got] == [expected, expected, None, None]
    assert got[0][1] != expected and len(got[0][1]) == 64
    assert pii.salt_configured("x") and not pii.salt_configured(" ")


def test_paths(values):
    rows = [
        ("bronze", "projeto_a/tb_a/_delta_log/000.json", "s3a://bronze/projeto_a/tb_a"),
        ("prata", "proj/int_x/_delta_log/", "s3a://prata/proj/int_x"),
        ("bronze", "projeto_a/tb_a/part-000.parquet", None),
        ("ouro", "_delta_log/000.json", "s3a://ouro"),
        ("ouro", "/a/_delta_log_old/_delta_log/1", "s3a://ouro/a"),
    ]
    got = values("b string, k string", [r[:2] for r in rows], paths.delta_uri_from_object_key("b", "k"))
    assert got == [r[2] for r in rows]

    uris = [("s3a://bronze/a/b/", "bronze", "a/b"), ("s3a://bronze", "bronze", ""), ("s3a://x/y", "bronze", "y")]
    assert values("u string, b string", [u[:2] for u in uris], paths.uri_to_root_prefix("u", "b")) == [
        u[2] for u in uris
    ]
    assert values("u string", [(" s3a://b/p ",)], paths.delta_uri("u"), paths.bucket_from_uri("u")) == [
        ("s3://b/p", "b")
    ]
    assert values("b string, p string", [("bronze", ""), (" /b/ ", "/p/q/")], paths.uri_from_parts("b", "p")) == [
        "s3a://bronze", "s3a://b/p/q",
    ]
    ephemeral = ["s3a://bronze/d/_meta/ci/system=SIA/run_id=manual__1", "s3a://bronze/projeto_a/tb_paciente",
                 "s3a://b/x/_meta/system=1", "s3a://b/system=1", "s3a://b/RUN_ID=3"]
    assert values("u string", [(u,) for u in ephemeral], paths.is_ephemeral_delta_uri("u")) == [
        True, False, True, False, True,
    ]
    keys = ["proj/_tmp/out.parquet", "proj/tb/part-000.parquet", "TMP/x", "a/tmp", "x/__pycache__/y"]
    assert values("k string", [(k,) for k in keys], paths.is_temp_object_key("k")) == [
        True, False, True, False, True,
    ]
    assert values("k string", [("a/b/c",), ("",), ("x",)], paths.path_prefixes("k")) == [
        ["", "a", "a/b", "a/b/c"], [""], ["", "x"],
    ]
    assert values("k string", [("a/b/c",), ("x",), ("a/",), ("a//",)], paths.parent_folder("k")) == [
        "a/b", "", "a", "a/",
    ]


def test_growth(values):
    rows = [(150, 100), (100, 100), (None, 100), (100, None), (50, 0), (0, 0)]
    assert values("a long, b long", rows, labels.growth_pct("a", "b")) == [50.0, 0.0, None, None, 100.0, None]


def test_one_decimal_agrees_with_python(values):
    rng = random.Random(3)
    numbers = [k / 20 for k in range(-400, 400)] + [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    numbers += [rng.randrange(10**6) / 100 for _ in range(3000)] + [0.95, 9.95, 99.95, 999.96, 1e12 + 0.25]
    got = values("v double", [(n,) for n in numbers], labels.one_decimal("v"))
    wrong = [(n, g) for n, g in zip(numbers, got) if g != f"{n:.1f}" and n != 0]
    assert not wrong, wrong[:5]


def test_report_texts(values):
    rows = [(0,), (1024,), (1024**3,), (None,), (-5,), (1023,), (5 * 1024**5,), (1536 * 1024,)]
    assert values("n long", rows, labels.format_bytes("n")) == [
        "0 B", "1.0 KiB", "1.0 GiB", "?", "0 B", "1023 B", "5.0 PiB", "1.5 MiB",
    ]
    assert values("g double", [(None,), (12.34,), (-5.0,), (0.0,)], labels.format_growth_pct("g")) == [
        "sem base anterior", "+12.3%", "-5.0%", "0.0%",
    ]


@pytest.mark.parametrize(
    "run_type, external, origin, expected",
    [
        ("scheduled", False, None, "agendado"), ("manual", False, None, "manual"),
        ("MANUAL", True, None, "manual"), ("backfill", False, None, "backfill"),
        ("dataset_triggered", False, None, "dataset"), ("asset_triggered", False, None, "asset"),
        ("", True, None, "manual"), ("", False, None, "outro"), ("", False, "ui", "manual"),
        ("custom", False, None, "custom"),
    ],
)
def test_trigger(values, run_type, external, origin, expected):
    got = values("r string, e boolean, o string", [(run_type, external, origin)],
                 labels.classify_trigger("r", "e", "o"))
    assert got == [expected]
