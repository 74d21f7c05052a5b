"""Loading delimited records of which some fail to parse.

Blocks of records are parsed at once on a columnar path: Arrow's CSV reader reads the
block's text, whole columns are checked and cast. The parser says that a block fails,
not where; a failing block is halved and its halves are parsed on their own, again
and again (a half whose other half loads must be the failing one and is halved without another
parse). What is left of a failing block at ``LEAF`` records is parsed strictly, one
record at a time, which gives the reason of each failure. The fast path may refuse a
record that loads (the strict one then loads it), but loads none that fails.

Defined cases: a NULL or empty record fails ("no record"); an empty value is missing
and comes out as NULL; repeated records each come out; records may be of any length;
an empty table gives an empty result. Of the input only the record column and the
columns named by ``keep`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame

BLOCK = 1024
LEAF = 8  # a block so small is diagnosed: that costs less than parsing its parts

# The layout of a record.
NAMES = (
    "transaction_code", "service_code", "transaction_status",
    "transaction_date__date_part", "transaction_date__fraction_ns", "transaction_amount", "request_reference",
    "request_date__date_part", "request_date__fraction_ns", "response_date__date_part", "response_date__fraction_ns",
    "source_phone", "destination_phone", "transaction_fees", "destination_type",
    "source_customer_or_destination_customer_candidate", "batch_id_or_reconciliation_reference",
    "accounting_reference_or_second_batch_field", "partner_reference", "transaction_direction", "qr_indicator",
    "settlement_status_candidate", "unclear_position_22", "unclear_position_23", "channel_type_candidate",
    "unclear_position_25",
)
MOST_VALUES = 30
DATES = (3, 7, 9)
FRACTIONS = (4, 8, 10)
NUMBERS = (5, 13)
WHOLE = (0, 25)
_DATE = r"[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
PATTERNS = {
    0: r"[0-9]+",
    1: r"SERVICE_(?:0[1-9]|1[0-2])",
    2: r"VALIDATED|REJECTED|INCOMPLETE|REGISTERED|EXPIRED",
    3: _DATE,
    4: r"(?:[0-9]{1,9})?",
    5: r"[0-9]+(?:\.[0-9]+)?",
    7: rf"(?:{_DATE})?",
    8: r"(?:[0-9]{1,9})?",
    9: _DATE,
    10: r"(?:[0-9]{1,9})?",
    11: r"TEL[0-9]{8}",
    12: r"(?:TEL[0-9]{8})?",
    13: r"(?:[0-9]+(?:\.[0-9]+)?)?",
    25: r"[0-9]*",
}

_STRICT_VALUE = re.compile(r'"((?:[^"]|"")*)"|([^",\r\n]*)')
_STRICT = {p: re.compile(x) for p, x in PATTERNS.items()}


@dataclass(frozen=True)
class Failure(Exception):
    reason: str


def split_record(line: str) -> list[str]:
    """The values of a record; Failure if its quoting is broken."""
    if '"' not in line and "\n" not in line and "\r" not in line:
        return line.split(",")
    values, at = [], 0
    while True:
        m = _STRICT_VALUE.match(line, at)
        values.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if at == len(line):
            return values
        if line[at] != ",":
            raise Failure("broken quoting")
        at += 1


def _real(date: str) -> datetime:
    d, m, y, hour, minute, second = (int(date[i:i + 2]) for i in (0, 3, 6, 9, 12, 15))
    return datetime(2000 + y, m, d, hour, minute, second)


def parse_strictly(line: str | None) -> list[str]:
    """The 26 values of a record that loads; Failure with the reason otherwise."""
    if not line:
        raise Failure("no record")
    values = split_record(line)
    if not len(NAMES) <= len(values) <= MOST_VALUES:
        raise Failure(f"{len(values)} values")
    for p in range(len(NAMES), len(values)):
        if values[p]:
            raise Failure(f"value at position {p}, after the last column")
    for p, pattern in _STRICT.items():
        if not pattern.fullmatch(values[p]):
            raise Failure(f"invalid {NAMES[p]}" if values[p] else f"missing {NAMES[p]}")
        if p in DATES and values[p]:
            try:
                _real(values[p])
            except ValueError:
                raise Failure(f"no real date in {NAMES[p]}") from None
    return values[:len(NAMES)]


class BlockFails(Exception):
    """Some record of a block does not load."""


_SERVICES = pa.array([f"SERVICE_{i:02d}" for i in range(1, 13)])
_STATUSES = pa.array(["VALIDATED", "REJECTED", "INCOMPLETE", "REGISTERED", "EXPIRED"])
_TAIL = tuple(range(len(NAMES), MOST_VALUES))
_CHECKED = (*PATTERNS, *_TAIL)
_PADS = pa.array([",\n", ",,\n", ",,,\n", ",,,,\n", "\n"])  # by how many values are missing of 30, less one; "\n" for none
_ORDINAL = "#"
_DAYS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without NULLs, without copying."""
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int32, len(col) + 1, col.offset * 4)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[ends[0]:ends[-1]], ends - ends[0]


def _need(holds) -> None:
    if not holds:
        raise BlockFails


def _dates(cols: Sequence[pa.Array], may_be_empty: Sequence[bool]) -> None:
    """dd/MM/yy HH:mm:ss, real dates of the years 2000 to 2099, in whole columns."""
    parts = []
    for col, optional in zip(cols, may_be_empty):
        data, ends = _bytes(col)
        length = np.diff(ends)
        _need(((length == 17) | (length == 0) if optional else length == 17).all())
        parts.append(data)
    x = np.concatenate(parts).reshape(-1, 17)
    _need((x[:, [2, 5]] == 47).all() and (x[:, 8] == 32).all() and (x[:, [11, 14]] == 58).all())
    tens, ones = x[:, [0, 3, 6, 9, 12, 15]] - 48, x[:, [1, 4, 7, 10, 13, 16]] - 48
    _need((tens < 10).all() and (ones < 10).all())
    day, month, year, hour, minute, second = (tens * 10 + ones).T
    _need(((month >= 1) & (month <= 12)).all())
    last = _DAYS[month - 1] + ((month == 2) & (year % 4 == 0))
    _need(((day >= 1) & (day <= last) & (hour < 24) & (minute < 60) & (second < 60)).all())


def _digits(cols: Sequence[pa.Array]) -> list[np.ndarray]:
    """That the values are digits or empty; their lengths, column by column."""
    pairs = [_bytes(c) for c in cols]
    _need((np.concatenate([d for d, _ in pairs]) - 48 < 10).all())
    return [np.diff(ends) for _, ends in pairs]


def _phones(col: pa.Array, optional: bool) -> None:
    data, ends = _bytes(col)
    length = np.diff(ends)
    _need(((length == 11) | (length == 0) if optional else length == 11).all())
    x = data.reshape(-1, 11)
    _need((x[:, :3] == (84, 69, 76)).all() and (x[:, 3:] - 48 < 10).all())


def _quotes(raw: np.ndarray) -> None:
    """That every quote opens a value, closes one or is doubled inside one."""
    at = np.flatnonzero(raw == 34)
    _need(len(at) % 2 == 0)
    before, after = raw[at[::2] - 1], raw[at[1::2] + 1]
    _need(((before == 44) | (before == 34)).all() and ((after == 44) | (after == 34) | (after == 10)).all())


class Blocks:
    """The records of a batch as one text, of which any stretch can be parsed as a block.

    Each record is preceded by its ordinal, which shows that a row of the reader is a record, and
    followed by the commas of the values it may leave out, at most four: the reader sees
    31 values, or fails.
    """

    def __init__(self, records: pa.Array, every: bool):
        filled = pc.fill_null(records if pa.types.is_string(records.type) else records.cast(pa.string()), "")
        missing = MOST_VALUES - 1 - self._commas(filled)
        pads = _PADS.take(pa.array(np.where((missing > 0) & (missing <= MOST_VALUES - len(NAMES)), missing - 1, len(_PADS) - 1)))
        lead = pa.array(np.arange(len(records))).cast(pa.string())
        text = pc.binary_join_element_wise(pc.binary_join_element_wise(lead, filled, ","), pads, "")
        _, offsets, self.data = text.buffers()
        self.ends = np.frombuffer(offsets, np.int32, len(text) + 1, text.offset * 4)
        self.raw = np.frombuffer(self.data, np.uint8)
        names = [_ORDINAL, *map(str, range(MOST_VALUES))]
        wanted = names if every else [_ORDINAL, *map(str, _CHECKED)]
        self.parsing = pcsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False)
        self.names = names
        self.converting = pcsv.ConvertOptions(column_types={_ORDINAL: pa.int64()} | dict.fromkeys(wanted[1:], pa.string()), strings_can_be_null=False, include_columns=wanted)
        self.parses = 0

    @staticmethod
    def _commas(records: pa.Array) -> np.ndarray:
        """The commas of each record outside quotes."""
        commas = pc.count_substring(records, ",").to_numpy(zero_copy_only=False).astype(np.int64)
        quoted = np.flatnonzero(pc.match_substring(records, '"').to_numpy(zero_copy_only=False))
        if len(quoted):
            data, ends = _bytes(records.take(pa.array(quoted)))
            odd = np.append(0, np.cumsum(data == 34, dtype=np.int64))
            at = np.flatnonzero(data == 44)
            record = np.searchsorted(ends, at, side="right") - 1
            outside = (odd[at] - odd[ends[record]]) % 2 == 0
            commas[quoted] = np.bincount(record[outside], minlength=len(quoted))
        return commas

    def parse(self, begin: int, end: int) -> pa.Table:
        """The columns of records begin to end; BlockFails if one of them does not load, whichever."""
        self.parses += 1
        a, b = int(self.ends[begin]), int(self.ends[end])
        try:
            got = pcsv.read_csv(pa.py_buffer(self.data.slice(a, b - a)), pcsv.ReadOptions(column_names=self.names, use_threads=False, block_size=b - a + 64),
                                self.parsing, self.converting)
        except pa.ArrowInvalid:
            raise BlockFails from None
        _need(got.num_rows == end - begin and got.column(0).num_chunks == 1)
        col = lambda p: got.column(str(p)).chunk(0)
        _need((got.column(0).chunk(0).to_numpy() == np.arange(begin, end)).all())
        _need(not any(_bytes(col(p))[1][-1] for p in _TAIL))
        _dates([col(p) for p in DATES], [False, True, False])
        code, *fractions, _ = _digits([col(p) for p in (WHOLE[0], *FRACTIONS, WHOLE[1])])
        _need((code > 0).all() and max(x.max() for x in fractions) <= 9)
        _phones(col(11), False)
        _phones(col(12), True)
        _need(pc.all(pc.is_in(col(1), _SERVICES)).as_py() and pc.all(pc.is_in(col(2), _STATUSES)).as_py())
        for p in NUMBERS:
            _need(pc.all(pc.match_substring_regex(col(p), rf"^(?:{PATTERNS[p]})\z")).as_py())
        raw = self.raw[a:b]
        if (raw == 34).any():
            _quotes(raw)
        return got


def bisect(records: pa.Array, block: int = BLOCK, every: bool = False) -> tuple[list[tuple[int, int, pa.Table]], list[tuple[int, list[str]]], list[tuple[int, str]], int]:
    """What loads in blocks, what loads strictly, what fails, and how many blocks were parsed.

    ([(begin, end, columns)], [(position, values)], [(position, reason)], parses); ``every``: with all columns.
    """
    blocks = Blocks(records, every)
    good: list[tuple[int, int, pa.Table]] = []
    strict: list[tuple[int, list[str]]] = []
    bad: list[tuple[int, str]] = []

    def loads(begin: int, end: int, must_fail: bool) -> bool:
        if not must_fail:
            try:
                good.append((begin, end, blocks.parse(begin, end)))
                return True
            except BlockFails:
                pass
        if end - begin > LEAF:
            middle = (begin + end) // 2
            loads(middle, end, loads(begin, middle, False))
            return False
        for i in range(begin, end):
            try:
                strict.append((i, parse_strictly(records[i].as_py())))
            except Failure as f:
                bad.append((i, f.reason))
        return False

    for begin in range(0, len(records), block):
        loads(begin, min(begin + block, len(records)), False)
    return good, strict, bad, blocks.parses


def _missing(col: pa.Array) -> pa.Array:
    return pc.if_else(pc.equal(col, ""), pa.scalar(None, pa.string()), col)


def _whole(col: pa.Array) -> pa.Array:
    """Digits as bigint; what does not fit one is NULL (the record still loads)."""
    fits = pc.less_equal(pc.binary_length(pc.utf8_ltrim(col, "0")), 18)
    return pc.if_else(fits, _missing(col), pa.scalar(None, pa.string())).cast(pa.int64())


def _micros(col: pa.Array) -> pa.Array:
    """dd/MM/yy HH:mm:ss of real dates as microseconds since 1970."""
    part = lambda a, b: pc.utf8_slice_codeunits(col, a, b)
    text = pc.binary_join_element_wise("20", part(6, 8), "-", part(3, 5), "-", part(0, 2), "T", part(9, 17), "")
    return pc.if_else(pc.equal(col, ""), pa.scalar(None, pa.string()), text).cast(pa.timestamp("us")).cast(pa.int64())


def _typed(cols: Sequence[pa.Array]) -> list[pa.Array]:
    """The typed columns: dates hold microseconds, their fractions stay beside them."""
    out = []
    for p in range(len(NAMES)):
        col = cols[p]
        if p in DATES:
            fraction = _missing(cols[p + 1]).cast(pa.int64()).fill_null(0)
            out.append(pc.add(_micros(col), pc.divide(fraction, 1000)).cast(pa.timestamp("us")))
        elif p in FRACTIONS:
            out.append(_missing(col).cast(pa.int64()))
        elif p in NUMBERS:
            out.append(_missing(col).cast(pa.float64()))
        elif p in WHOLE:
            out.append(_whole(col))
        else:
            out.append(_missing(col))
    return out


def parse_block(records: pa.Array, block: int = BLOCK) -> tuple[np.ndarray, list[pa.Array]]:
    """(positions of the records that load, their typed columns)."""
    good, strict, _, _ = bisect(records, block, every=True)
    at = np.concatenate([*[np.arange(a, b) for a, b, _ in good], np.array([i for i, _ in strict], np.int64)]).astype(np.int64)
    names = [*map(str, range(len(NAMES)))]
    apart = pa.table([pa.array([v[p] for _, v in strict], pa.string()) for p in range(len(NAMES))], names)
    cols = pa.concat_tables([*[t.select(names) for _, _, t in good], apart])
    return at, _typed([c.combine_chunks() for c in cols.columns])


_ARROW = {**dict.fromkeys(DATES, pa.timestamp("us")), **dict.fromkeys((*FRACTIONS, *WHOLE), pa.int64()), **dict.fromkeys(NUMBERS, pa.float64())}
_SQL = {pa.timestamp("us"): "timestamp_ntz", pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string"}


def _loader(record: str, keep: Sequence[str], block: int, want: str):
    types = [_ARROW.get(p, pa.string()) for p in range(len(NAMES))]
    fields = [pa.field(n, t) for n, t in zip(NAMES, types)]

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lines = batch.column(record)
        kept = [batch.column(k) for k in keep]
        if want == "failed":
            bad = bisect(lines, block)[2]
            i = pa.array([i for i, _ in bad], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[k.take(i) for k in kept], lines.take(i), pa.array([r for _, r in bad], pa.string())], [*keep, record, "reason"])
        else:
            at, columns = parse_block(lines, block)
            yield pa.RecordBatch.from_arrays([*[k.take(pa.array(at)) for k in kept], *columns], schema=pa.schema(
                [*[pa.field(n, k.type) for n, k in zip(keep, kept)], *fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from one(batch)

    return run


def _run(raw: DataFrame, record: str, keep: Sequence[str], block: int, want: str) -> DataFrame:
    clash = {*keep} & ({*NAMES} if want == "loaded" else {record, "reason"})
    if clash:
        raise ValueError(f"kept columns with the name of a result column: {sorted(clash)}")
    slim = raw.select(*keep, record)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema]
    own = ([f"`{n}` {_SQL[_ARROW.get(p, pa.string())]}" for p, n in enumerate(NAMES)] if want == "loaded"
           else [f"`{record}` string", "reason string"])
    return slim.mapInArrow(_loader(record, keep, block, want), ", ".join([*kept, *own]))


def load_records(raw: DataFrame, record: str, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """The records that load, as typed rows, with the columns ``keep`` beside them."""
    return _run(raw, record, keep, block, "loaded")


def failed_records(raw: DataFrame, record: str, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """The records that do not load: the columns ``keep``, the record and its first reason."""
    return _run(raw, record, keep, block, "failed")
