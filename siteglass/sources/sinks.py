"""Writers: CSV, JSON, JSON lines, XLSX, XML sitemaps, WARC archives and page upserts; and the sitemap reader."""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.functions import urls
from siteglass.storage import open_path

PER_SITEMAP = 49_999
XMLNS = "http://www.sitemaps.org/schemas/sitemap/0.9"


def strings(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of part files with headers; quotes are doubled."""
    strings(rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    strings(rows).write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One indented array. Rows stream through the driver one partition at a time, as one file needs one writer."""
    fs, at = open_path(path if "://" in path else f"file://{path}")
    with fs.open_output_stream(at) as out:
        n = 0
        for row in strings(rows).toLocalIterator():
            out.write((",\n" if n else "[\n").encode() + "\n".join("  " + x for x in json.dumps(row.asDict(), indent=2, ensure_ascii=False).split("\n")).encode())
            n += 1
        out.write(b"\n]\n" if n else b"[]\n")


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_xlsx(rows: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """A workbook with a header and string cells; a sheet holds 1,048,576 rows at most, more is an error."""
    data = strings(rows)
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    clean = {c: None for c in range(32) if c not in (9, 10, 13)}

    def line(n: int, values: list[str]) -> bytes:
        cells = "".join(f'<c r="{column_name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v.translate(clean))}</t></is></c>' for i, v in enumerate(values))
        return f'<row r="{n}">{cells}</row>'.encode()

    fs, at = open_path(path if "://" in path else f"file://{path}")
    with fs.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet_out:
            sheet_out.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + line(1, data.columns))
            for n, row in enumerate(data.toLocalIterator(), 2):
                if n > 1_048_576:
                    raise ValueError("a sheet has 1,048,576 rows at most")
                sheet_out.write(line(n, list(row)))
            sheet_out.write(b"</sheetData></worksheet>")


def sitemap_rows(pages: DataFrame, per_file: int = PER_SITEMAP, lastmod: bool = False, non_html: bool = False) -> DataFrame:
    """(chunk, place, loc, lastmod): indexable internal pages in order of URL, numbered in files.

    The order is total but not sorted in one task: URLs are range-partitioned, counted by partition, and numbered from
    their partition's offset.
    """
    ok = pages.where("scope = 'internal' AND state = 'crawled' AND status_code BETWEEN 200 AND 299 AND indexable")
    if not non_html:
        ok = ok.where("content_type LIKE '%text/html%' OR content_type LIKE '%application/xhtml%'")
    day = F.date_format(F.try_to_timestamp(F.regexp_extract(F.col("headers")["Last-Modified"], r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")), "yyyy-MM-dd") if lastmod else F.lit(None).cast("string")
    rows = ok.select(F.col("url").alias("loc"), day.alias("lastmod")).repartitionByRange("loc").sortWithinPartitions("loc")
    rows = rows.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.expr("shiftright(id, 33)"))
    sizes = [(r[0], r[1]) for r in rows.groupBy("part").count().orderBy("part").collect()]
    total, starts = 0, {}
    for part, n in sizes:
        starts[part], total = total, total + n
    if not starts:
        return rows.select(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("place"), "loc", "lastmod")
    offset = F.create_map(*[x for p, s in starts.items() for x in (F.lit(p), F.lit(s))])[F.col("part")]
    number = offset + F.col("id") - F.shiftleft("part", 33)
    return rows.select(number.alias("n"), "loc", "lastmod").select(F.floor(F.col("n") / per_file).cast("long").alias("chunk"), (F.col("n") % per_file).alias("place"), "loc", "lastmod")


def write_sitemaps(pages: DataFrame, folder: str, index_base: str = "", base: str = "sitemap", **options) -> list[str]:
    """Sitemap files of at most 49,999 URLs each, and an index if there are several; the files' names."""
    rows = sitemap_rows(pages, **options)
    numbers = sorted(r[0] for r in rows.select("chunk").distinct().collect())
    names = {n: f"{base}.xml" if len(numbers) < 2 else f"{base}-{n + 1}.xml" for n in numbers or [0]}

    def run(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        fs, at = open_path(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{names[key[0]]}") as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{XMLNS}">\n'.encode())
            for loc, day in chunk.sort_values("place")[["loc", "lastmod"]].itertuples(index=False):
                out.write(f"  <url>\n    <loc>{escape(loc)}</loc>\n{f'    <lastmod>{day}</lastmod>{chr(10)}' if isinstance(day, str) else ''}  </url>\n".encode())
            out.write(b"</urlset>\n")
        return pd.DataFrame({"name": [names[key[0]]]})

    written = sorted(r[0] for r in rows.groupBy("chunk").applyInPandas(run, "name string").collect())
    if len(numbers) > 1:
        fs, at = open_path(folder if "://" in folder else f"file://{folder}")
        with fs.open_output_stream(f"{at}/{base}-index.xml") as out:
            entries = "".join(f"  <sitemap>\n    <loc>{escape(index_base.removesuffix('/'))}/{names[n]}</loc>\n  </sitemap>\n" for n in numbers)
            out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{XMLNS}">\n{entries}</sitemapindex>\n'.encode())
        written.append(f"{base}-index.xml")
    return written


def read_sitemaps(spark: SparkSession, path: str, row: str = "url") -> DataFrame:
    """(sitemap, url) of sitemap files; row 'sitemap' reads an index's entries instead."""
    schema = "loc string"
    got = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return got.select(F.input_file_name().alias("sitemap"), F.trim("loc").alias("url")).where("url <> ''")


def walk_sitemaps(fetched: DataFrame, starts: DataFrame, deepest: int = 2) -> DataFrame:
    """(sitemap, depth, url, error) from fetched sitemap files (url, status_code, xml) and where to start (url).

    Index entries are followed down to ``deepest``; each file is read once, at its least depth. Listed URLs are normalised.
    A file that is missing, failed or isn't XML of a sitemap gives one row with an error, and the others go on.
    """
    shape = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>"
    files = fetched.select(F.col("url").alias("sitemap"), "status_code", "xml")
    now, read = starts.select(F.col("url").alias("sitemap")).distinct(), None
    for depth in range(deepest + 1):
        here = now.join(files, "sitemap", "left").withColumn("depth", F.lit(depth))
        plain = F.regexp_replace("xml", r'xmlns(:\w+)?="[^"]*"', "")
        good = (F.col("status_code") == 200) & F.col("xml").rlike(r"<(?:\w+:)?(?:urlset|sitemapindex)[\s>]")
        here = here.withColumn("found", F.when(good, F.from_xml(plain, shape))).select(
            "sitemap", "depth", F.when(F.col("status_code").isNull(), "not fetched").when(F.col("status_code") != 200, F.concat(F.lit("status "), F.col("status_code").cast("string"))).when(~good, "no sitemap").alias("error"),
            F.transform(F.coalesce("found.sitemap", F.array()), lambda x: F.trim(x["loc"])).alias("children"), F.transform(F.coalesce("found.url", F.array()), lambda x: F.trim(x["loc"])).alias("urls"),
        )
        read = here if read is None else read.union(here)
        now = here.select(F.explode("children").alias("sitemap")).where("sitemap <> ''").distinct().join(read.select("sitemap"), "sitemap", "left_anti")
    listed = read.select("sitemap", "depth", F.explode("urls").alias("url"), F.lit(None).cast("string").alias("error")).withColumn("url", urls.normalize("url")).where("url IS NOT NULL")
    return listed.union(read.where("error IS NOT NULL").select("sitemap", "depth", F.lit(None).cast("string"), "error"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(authority, url) of the sitemaps that robots.txt files (authority, text) name; an authority that names none has /sitemap.xml."""
    named = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))
    usual = F.array(F.concat(F.lit("https://"), "authority", F.lit("/sitemap.xml")))
    return robots.select("authority", F.explode(F.when(F.size(named) > 0, named).otherwise(usual)).alias("url")).distinct()


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of every http(s) URL in text files."""
    lines = spark.read.text(path)
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"""https?://[^\s"'<>]+"""), F.lit(0))).alias("url")).distinct()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def write_warc(pages: DataFrame, folder: str, fields: dict[str, str]) -> DataFrame:
    """A gzip archive per partition of fetched pages (url, status_code, status, http_version, headers, html): (archive, records)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        stamp = pd.Timestamp.now("UTC").strftime("%Y-%m-%dT%H:%M:%SZ")
        common = lambda kind: [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", stamp)]
        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    fs, at = open_path(folder if "://" in folder else f"file://{folder}")
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    info = "".join(f"{k}: {fields[k]}\r\n" for k in sorted(fields)).encode()
                    out.write(warc_record([*common("warcinfo"), ("Content-Type", "application/warc-fields")], info))
                block = io.BytesIO()
                block.write(f"{r.http_version} {r.status_code} {r.status}\r\n".encode())
                for k, v in sorted(dict(r.headers or {}).items()):
                    for one in (v or "").split("\n"):
                        block.write(f"{k}: {one}\r\n".encode())
                block.write(b"\r\n" + (r.html or "").encode())
                out.write(warc_record([*common("response"), ("WARC-Target-URI", r.url), ("Content-Type", "application/http; msgtype=response")], block.getvalue()))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [name], "records": [n]})

    return pages.select("url", "status_code", "status", "http_version", "headers", "html").mapInPandas(run, "archive string, records long")


def newest_by_url(rows: DataFrame, order: str = "version") -> DataFrame:
    """The last version of each URL; the aggregate keeps one row a key and task before it shuffles."""
    columns = [c for c in rows.columns if c != "url"]
    best = rows.groupBy("url").agg(F.max_by(F.struct(*columns), F.col(order)).alias("x"))
    return best.select("url", *[F.col(f"x.{c}").alias(c) for c in columns])
