"""Reading and writing the CSV inputs and the JSON labels; bad records go to quarantine with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions.scalar import clean_text, net_paise, parse_date, to_paise
from ledgerweave.storage import counted, cut

#: Headers of the files.
SETTLEMENT = ["row_id", "kind", "order_id", "gross", "fee", "tax", "settled_on", "settlement_id", "method", "utr"]
BANK = ["txn_id", "value_date", "narration", "credit", "debit"]
ORDERS = ["order_id", "placed_on", "gross", "customer_id"]


@dataclass
class Parsed:
    """A directory's tables; quarantine is source, line_no, raw, reason."""

    settlement: DataFrame
    bank: DataFrame
    orders: DataFrame
    quarantine: DataFrame


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, names anything."""
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


#: One field: quoted (a doubled quote stands for one; what follows the closing quote is plain), plain, or empty.
QUOTED = r'[^"]*+(?:""[^"]*+)*+'
FIELD = rf'(?:"{QUOTED}"[^,]*+|[^",][^,]*+|)'
ENDS_AFTER_PLAIN_START = rf"^{FIELD}(?:,{FIELD})*+$"
ENDS_AFTER_QUOTED_START = rf'^{QUOTED}"[^,]*+(?:,{FIELD})*+$'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (where it starts), at (order in the block) and out, in: whether a quoted field is open after the line, if none or one is open before it."""
    # A line without quotes leaves things as they are.
    open_after = lambda pattern, plain: F.when(F.contains("value", F.lit('"')), ~F.col("value").rlike(pattern)).otherwise(plain).cast("int")
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        open_after(ENDS_AFTER_PLAIN_START, False).alias("out"), open_after(ENDS_AFTER_QUOTED_START, True).alias("in"),
    )


def _open_before(order: Window, start: Column) -> Column:
    """Whether a quoted field is open before a row, from the rows before it in order and the state at their start.

    A row either sets the state (out = in), keeps it, or turns it; so the state is that of the last row that sets it,
    turned as often as rows turn it since. turns: how many rows up to this one turn it.
    """
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when((F.col("out") == 1) & (F.col("in") == 0), 1).otherwise(0)).over(earlier), F.lit(0))
    set_at = F.last(F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("state"), F.col("turned").alias("turned"))), ignorenulls=True).over(earlier)
    return F.when(set_at.isNotNull(), (set_at["state"] + turns - set_at["turned"]) % 2).otherwise((start + turns) % 2)


def _turned(df: DataFrame, order: Window) -> DataFrame:
    turns = F.when((F.col("out") == 1) & (F.col("in") == 0), 1).otherwise(0)
    return df.withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _joined_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """file, line_no, value of whole records of files in which a field goes over a line break.

    A block's effect on an open field follows from its lines, so the state at the start of every block follows from a row a
    block, and each block's lines are then told apart on their own. A record that no quote closes goes on to the end of its file.
    """
    in_block, in_file = Window.partitionBy("file", "block").orderBy("at"), Window.partitionBy("file").orderBy("block")
    seen = _turned(lines, in_block)
    first = _open_before(in_block, F.lit(0)), _open_before(in_block, F.lit(1))
    step = lambda before: F.when(before == 1, F.col("in")).otherwise(F.col("out"))
    seen = seen.withColumn("b0", first[0]).withColumn("b1", first[1])
    effect = seen.groupBy("file", "block").agg(F.max_by(step(F.col("b0")), "at").alias("out"), F.max_by(step(F.col("b1")), "at").alias("in"))
    starts = _turned(effect, in_file).select("file", "block", _open_before(in_file, F.lit(0)).alias("open"))
    placed = seen.drop("out", "in", "turned").join(starts, ["file", "block"]).join(blocks.select("file", "block", "first", "before"), ["file", "block"])
    placed = placed.select("file", "block", "at", "value", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), F.when(F.col("open") == 1, F.col("b1")).otherwise(F.col("b0")).alias("inside"))
    # A record is named by the number of its first line; one that began in an earlier block has that block's last.
    begun = placed.withColumn("record", F.max(F.when(F.col("inside") == 0, F.col("line_no"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    last = begun.groupBy("file", "block").agg(F.max("record").alias("last"))
    carried = last.select("file", "block", F.last("last", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    whole = begun.join(carried, ["file", "block"]).withColumn("record", F.coalesce("record", "carried"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "value")))
    return whole.groupBy("file", F.col("record").alias("line_no")).agg(F.array_join(parts["value"], "\n").alias("value"))


def _records(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The wanted columns as text, raw, line_no, width_ok. Each file's column order comes from its own header line; a missing column reads as null.

    Lines are read by many tasks. Every line counts, blank ones too; a field in quotes may go over line breaks. line_no
    is the position of a record's first line, the header being 1; the files of a folder are numbered through in the
    order of their paths. Lines are only put together in files where a quoted field stays open at the end of a line.
    """
    text = _lines(spark, path)
    # A task reads a block's lines one after the other; the lines before a block follow from the blocks' counts.
    blocks = cut(text.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"), F.max("out").alias("breaks"), F.min_by("value", "at").alias("top")), "blocks")
    in_file = Window.partitionBy("file").orderBy("block")
    files = blocks.groupBy("file").agg(F.sum("lines").alias("lines"), F.max("breaks").alias("breaks"), F.min_by("top", "block").alias("top"))
    ahead = F.coalesce(F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    files = files.select("file", "breaks", ahead.alias("ahead"), F.transform(F.split("top", ","), lambda h: F.trim(F.regexp_replace(F.trim(h), '^"(.*)"$', "$1"))).alias("names"))
    # Where each wanted column stands in the file; -1: nowhere.
    files = cut(files.select("*", *[(F.array_position("names", n) - 1).cast("int").alias(f"at_{n}") for n in wanted]), "files")
    within = F.coalesce(F.sum("lines").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("within", within).join(files, "file").select("file", "block", "first", (F.col("ahead") + F.col("within")).alias("before"), (files["breaks"] == 1).alias("breaks"))
    broken = files.agg(F.max("breaks")).first()[0]
    # A row a block and a row a file are small beside the lines, which stay where they are.
    simple = text.join(F.broadcast(blocks.filter("not breaks")), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")
    if broken:
        torn = blocks.filter("breaks")
        simple = simple.unionByName(_joined_lines(text.join(torn.select("file").distinct(), "file", "left_semi"), torn))
    body = simple.join(F.broadcast(files.withColumn("width", F.size("names")).drop("breaks", "names")), "file").filter(F.col("line_no") > F.col("ahead") + 1)
    quoted = F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(rf',("{QUOTED}$|{FIELD})'), F.lit(1))
    parsed = body.withColumn("f", F.when(F.contains("value", F.lit('"')), F.transform(quoted, _plain)).otherwise(F.split("value", ",")))
    blank = F.trim(F.translate("value", ",", " ")) == ""
    return parsed.select(F.col("value").alias("raw"), "line_no", ((F.size("f") == F.col("width")) & ~blank).alias("width_ok"), *[F.get("f", f"at_{n}").alias(n) for n in wanted])


def _plain(field: Column) -> Column:
    """A field without its quotes: what is quoted, a doubled quote as one, and what follows the closing quote."""
    inside, after = F.regexp_extract(field, f'^"({QUOTED})', 1), F.regexp_extract(field, f'^"{QUOTED}"([^,]*)', 1)
    return F.when(field.startswith('"'), F.concat(F.replace(inside, F.lit('""'), F.lit('"')), after)).otherwise(field)


def _scope(other: int) -> Column:
    return F.coalesce(F.trim("scope").try_cast("bigint"), F.lit(other)).cast("long").alias("scope")


def _judged(records: DataFrame, read: list[str], day: str, reason: Column, scope: int | None = None) -> DataFrame:
    """records with their amounts in paise, their day and the reason of those that are bad. With a scope all have one: of the file's own column of that name, else this.

    The columns pass through a generator, which no filter or projection is moved below: each is made once for a
    record, and not again wherever it is asked for.
    """
    of = [] if scope is None else [_scope(scope)]
    texts = [c for c in records.columns if c not in ("width_ok", "scope")]
    # As lambdas they are evaluated outside the generated code, which would grow beyond what the JVM compiles.
    made = records.select(*records.columns, F.transform(F.array(*read), to_paise).alias("paise"), F.get(F.transform(F.array(day), parse_date), F.lit(0)).alias("day"))
    made = made.select(*records.columns, "day", *(F.get("paise", F.lit(k)).alias(f"{c}_paise") for k, c in enumerate(read)))
    why = F.when(~F.col("width_ok"), "wrong column count").otherwise(reason).alias("reason")
    return made.select(F.inline(F.array(F.struct(*of, *texts, "day", *(f"{c}_paise" for c in read), why))))


def _split(source: str, judged: DataFrame, good: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Typed rows and quarantine, both with the scope if there is one."""
    of = ["scope"] if "scope" in judged.columns else []
    bad = judged.filter("reason is not null").select(*of, F.lit(source).alias("source"), "line_no", "raw", "reason")
    return judged.filter("reason is null").select(*of, *good), bad


def _amount_reason(c: str) -> Column:
    return F.when(F.col(f"{c}_paise").isNull(), F.concat(F.lit(f"unparseable amount in {c}: '"), F.coalesce(c, F.lit("")), F.lit("'")))


def _date_reason(c: str) -> Column:
    empty = F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(empty, "empty date").when(F.col("day").isNull(), F.concat(F.lit("unparseable date: '"), F.trim(c), F.lit("'")))


def settlement_reason() -> Column:
    """The first check that fails: gross, a file without row_id, kind, fee, tax, date."""
    zero = (F.col("gross_paise") == 0) & ~F.trim(F.coalesce("gross", F.lit(""))).isin("0", "0.00")
    return F.coalesce(
        _amount_reason("gross"), F.when(zero, F.concat(F.lit("unparseable amount: '"), F.coalesce("gross", F.lit("")), F.lit("'"))),
        F.when(F.col("row_id").isNull(), "missing row_id"), F.when(~F.coalesce(F.trim("kind").isin("payment", "refund", "adjustment"), F.lit(False)), F.concat(F.lit("'"), F.trim(F.coalesce("kind", F.lit(""))), F.lit("' is not a valid kind"))),
        _amount_reason("fee"), _amount_reason("tax"), _date_reason("settled_on"),
    )


def bank_reason() -> Column:
    both = (F.col("credit_paise") != 0) & (F.col("debit_paise") != 0)
    return F.coalesce(
        F.when(F.trim(F.coalesce("txn_id", F.lit(""))) == "", "missing txn_id"), _amount_reason("credit"), _amount_reason("debit"),
        F.when(both, "row has both credit and debit"), _date_reason("value_date"),
    )


def order_reason() -> Column:
    return F.coalesce(_date_reason("placed_on"), _amount_reason("gross"))


def typed_settlement() -> list[Column]:
    amounts = [F.col(f"{c}_paise") for c in ("gross", "fee", "tax")]
    return [
        F.trim("row_id").alias("row_id"), F.trim("kind").alias("kind"), clean_text(F.col("order_id")).alias("order_id"), *amounts,
        net_paise(F.trim("kind"), *amounts).alias("net_paise"), F.col("day").alias("settled_on"), clean_text(F.col("settlement_id")).alias("settlement_id"),
        clean_text(F.col("method"), "unknown").alias("method"), clean_text(F.col("utr")).alias("utr"), F.col("line_no").alias("row_seq"),
    ]


def typed_bank() -> list[Column]:
    return [
        F.trim("txn_id").alias("txn_id"), F.col("day").alias("value_date"), F.trim("narration").alias("narration"), "credit_paise", "debit_paise", F.col("line_no").alias("txn_seq"),
    ]


def typed_orders() -> list[Column]:
    return [F.trim("order_id").alias("order_id"), F.col("day").alias("placed_on"), "gross_paise", F.trim("customer_id").alias("customer_id")]


def read_settlement(spark: SparkSession, path: str, scope: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows and quarantine. Of rows with the same row_id (in a scope) all but the first go to quarantine."""
    records = _records(spark, path, [*SETTLEMENT, "scope"]).withColumn("row_id", F.trim("row_id"))
    judged = _judged(records, ["gross", "fee", "tax"], "settled_on", settlement_reason(), scope)
    key = ["row_id"] if scope is None else ["scope", "row_id"]
    # By hashes first, which are short: in most files no row_id occurs again.
    hashed = F.xxhash64(*key).alias("hash")
    repeated, n = counted((records if scope is None else records.withColumn("scope", _scope(scope))).groupBy(hashed).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "repeated")
    if n:
        first = judged.filter("reason is null").join(repeated, hashed == repeated["hash"], "left_semi").groupBy(*key).agg(F.min("line_no").alias("first"), F.count(F.lit(1)).alias("n"))
        judged = judged.join(cut(first.filter("n > 1").drop("n"), "first"), key, "left")
        judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("line_no") > F.col("first")), "duplicate row_id").otherwise(F.col("reason")))
    return _split("settlement_report", judged, typed_settlement())


def read_bank(spark: SparkSession, path: str, scope: int | None = None) -> tuple[DataFrame, DataFrame]:
    return _split("bank_statement", _judged(_records(spark, path, [*BANK, "scope"]), ["credit", "debit"], "value_date", bank_reason(), scope), typed_bank())


def read_orders(spark: SparkSession, path: str, scope: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A missing file reads as an empty table."""
    if not exists(spark, path):
        empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in [*ORDERS, "scope"]) + ", raw string, line_no long, width_ok boolean")
        return _split("orders", _judged(empty, ["gross"], "placed_on", order_reason(), scope), typed_orders())
    return _split("orders", _judged(_records(spark, path, [*ORDERS, "scope"]), ["gross"], "placed_on", order_reason(), scope), typed_orders())


#: The names of the files of a directory.
FILES = ["settlement_report.csv", "bank_statement.csv", "orders.csv"]


def load_directory(spark: SparkSession, path: str, scope: int | None = None) -> Parsed:
    """The tables of a directory. With a scope (of rows whose file has no column of that name) they fit reconcile."""
    settlement, a = read_settlement(spark, f"{path}/{FILES[0]}", scope)
    bank, b = read_bank(spark, f"{path}/{FILES[1]}", scope)
    orders, c = read_orders(spark, f"{path}/{FILES[2]}", scope)
    return Parsed(settlement, bank, orders, a.unionByName(b).unionByName(c))


def quarantine_by_reason(quarantine: DataFrame) -> DataFrame:
    """Counts by source and kind of reason (the quoted value cut off)."""
    kind = F.trim(F.regexp_replace("reason", "'.*'", ""))
    return quarantine.groupBy("source", kind.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def parse_totals(parsed: Parsed) -> DataFrame:
    """source, rows: how many rows of each kind were read."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
    return count(parsed.settlement, "settlement_report").unionByName(count(parsed.bank, "bank_statement")).unionByName(count(parsed.orders, "orders")).unionByName(count(parsed.quarantine, "quarantine"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """txn_id, scenario, expected_row_ids, expect_exception, note from a JSON document with `entries`."""
    kind = "entries array<struct<txn_id:string,scenario:string,expected_row_ids:array<string>,expect_exception:string,note:string>>, fee_drift_row_ids array<string>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def read_truth_drift(spark: SparkSession, path: str) -> DataFrame:
    """row_id of every settlement row that the label documents name as overcharged."""
    return spark.read.schema("fee_drift_row_ids array<string>").json(path, multiLine=True).select(F.explode("fee_drift_row_ids").alias("row_id"))


def rupees(c: Column) -> Column:
    """Paise as a rupee text, the sign first."""
    cents = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.call_function("div", cents, F.lit(100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def write_settlement_csv(df: DataFrame, path: str, scoped: bool = False, codec: str = "none") -> None:
    cols = [*([F.col("scope")] if scoped else []), *(F.col(c) for c in SETTLEMENT[:3]), *(rupees(F.col(f"{c}_paise")).alias(c) for c in ("gross", "fee", "tax")), F.col("settled_on").cast("string").alias("settled_on"), *(F.col(c) for c in SETTLEMENT[7:])]
    _write(df.select(*cols), path, codec)


def write_bank_csv(df: DataFrame, path: str, scoped: bool = False, codec: str = "none") -> None:
    _write(df.select(*(["scope"] if scoped else []), "txn_id", F.col("value_date").cast("string").alias("value_date"), "narration", rupees(F.col("credit_paise")).alias("credit"), rupees(F.col("debit_paise")).alias("debit")), path, codec)


def write_orders_csv(df: DataFrame, path: str, codec: str = "none") -> None:
    _write(df.select("order_id", F.col("placed_on").cast("string").alias("placed_on"), rupees(F.col("gross_paise")).alias("gross"), "customer_id"), path, codec)


def _write(df: DataFrame, path: str, codec: str) -> None:
    df.write.option("header", True).option("compression", codec).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)
