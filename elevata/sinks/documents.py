"""Spreadsheets, PDF pages and text files, with the standard library.

Reports are small; each project's file is written by the task that holds its
rows. Files go to a folder that all executors share (a URI for pyarrow.fs).
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame

from ..operators.report import QUANTITY_LINES, SECTIONS


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


class Bold(list):
    """A row in bold type."""


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    """A workbook: sheet name to rows of numbers, texts and empty cells. The
    first row and `Bold` ones are bold; columns are as wide as their texts, 40
    at most."""
    names = list(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, body: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body, zipfile.ZIP_DEFLATED)

        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}worksheet+xml"/>' for i in range(len(names)))
        put("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/>{parts}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + f'<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, n in enumerate(names):
            rows, body = sheets[n], []
            for r, cells in enumerate(rows):
                style = ' s="1"' if r == 0 or isinstance(cells, Bold) else ""
                row = []
                for c, v in enumerate(cells):
                    at = f"{_column(c)}{r + 1}"
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        row.append(f'<c r="{at}"{style}><v>{v!r}</v></c>')
                    elif v is not None:
                        row.append(f'<c r="{at}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{r + 1}">{"".join(row)}</row>')
            wide = [min(40, 4 + max((len(str(cells[c])) for cells in rows if c < len(cells) and cells[c] is not None), default=4)) for c in range(max(map(len, rows), default=0))]
            cols = "<cols>" + "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w}" customWidth="1"/>' for c, w in enumerate(wide)) + "</cols>" if wide else ""
            put(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}">{cols}<sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def pdf(bgr: np.ndarray, dpi: float, footer: str = "") -> bytes:
    """One page with an image at a resolution, and a line below it."""
    height, width = bgr.shape[:2]
    w, h = width / dpi * 72, height / dpi * 72
    pixels = zlib.compress(np.ascontiguousarray(bgr[..., ::-1]).tobytes(), 6)
    text = footer.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    page = b"q %.3f 0 0 %.3f 0 0 cm /I Do Q" % (w, h) + (b" BT /F 9 Tf 12 10 Td (" + text + b") Tj ET" if footer else b"")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Contents 4 0 R /Resources << /XObject << /I 5 0 R >> /Font << /F 6 0 R >> >> >>" % (w, h),
        b"<< /Length %d >>\nstream\n" % len(page) + page + b"\nendstream",
        b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (width, height, len(pixels)) + pixels + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n" % (i + 1) + body + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


#: Headings and lines of the workbook's sheets, with the columns
#: that they show.
DETAIL = ["Nr.", "Fatada", "Element", "Tip", "Latime (m)", "Inaltime (m)", "Suprafata (m²)"]
TOTALS = [
    ("TOTAL SUPRAFATA FATADE", "total_m2"), ("TOTAL TAMPLARIE (Ferestre + Usi)", "carpentry_m2"), ("TOTAL TERMOSISTEM (Fatade - Tamplarie)", "net_m2"), ("TOTAL SOCLU EXCLUS", "socle_m2"), ("TOTAL GLAF EXTERIOR", "sill_m"),
    ("TOTAL PICURATOR GOLURI", "drip_m"), ("TOTAL LUNGIME COLTARE", "corner_m"), ("TOTAL PICURATOR SOCLU", "socle_drip_m"), ("TOTAL PERIMETRU FERESTRE", "window_perimeter_m"), ("TOTAL PERIMETRU USI", "door_perimeter_m"),
]
SUMMARY = [
    ("Sup. Totala (m²)", "total_m2"), ("Tamplarie (m²)", "carpentry_m2"), ("Termosistem (m²)", "net_m2"), ("Soclu exclus (m²)", "socle_m2"), ("Glaf exterior (m)", "sill_m"), ("Picurator goluri (m)", "drip_m"),
    ("Coltare (m)", "corner_m"), ("Picurator soclu (m)", "socle_drip_m"), ("Perimetru ferestre (m)", "window_perimeter_m"), ("Perimetru usi (m)", "door_perimeter_m"),
]
KINDS = {"window": "Fereastra", "door": "Usa"}


def workbook_sheets(project: str, facades: list[dict], elements: list[dict], client: dict[str, str] | None = None) -> dict[str, list[list]]:
    """The three sheets of a project: facades with their openings, subtotals
    and totals; a summary of a row a facade; and the list of quantities.

    ``facades``: facade_id, name and the quantities in m2 and m; ``elements``:
    facade_id, element_id, kind, label, area_m2.
    """
    facades = sorted(facades, key=lambda f: f["facade_id"])
    total = lambda c: round(sum(f[c] for f in facades), 6)
    first = [Bold([f"RAPORT CANTITATI - {project}"]), [], [], Bold(DETAIL)]
    for n, f in enumerate(facades, 1):
        first.append(Bold([n, f["name"], "FATADA", "Termosistem", None, None, f["total_m2"]]))
        for kind, shown in KINDS.items():
            own = sorted((e for e in elements if e["facade_id"] == f["facade_id"] and e["kind"] == kind), key=lambda e: e["element_id"])
            first += [[None, f["name"], e["label"], shown, None, None, e["area_m2"]] for e in own]
        first.append(Bold([f"  Subtotal {f['name']}", None, None, None, None, f["carpentry_m2"], f["net_m2"]]))
    first.append([])
    first += [Bold([label, None, None, None, None, None, total(c)]) for label, c in TOTALS]
    second = [Bold(["SUMAR PROIECT"]), [], Bold(["Fatada", *(h for h, _ in SUMMARY)])]
    second += [[f["name"], *(f[c] for _, c in SUMMARY)] for f in facades] + [Bold(["TOTAL", *(total(c) for _, c in SUMMARY)])]
    third = [Bold(["LISTA CANTITĂȚI TERMOIZOLARE"])] + [[label, value] for label, value in (client or {}).items() if value] + [[]]
    for section, title in SECTIONS.items():
        lines = [x for x in QUANTITY_LINES if x[0] == section]
        third += [] if section == 5 else [Bold([title]), ["Descriere", "mp", "ml"]]
        for _, _, label, c, unit in lines:
            value = round(total(f"{c}_m2" if unit == "mp" else f"{c}_m"), 2) if c else 0
            row = [label, value, None] if unit == "mp" else [label, None, value]
            third.append(Bold(row) if section == 5 else row)
        third.append([])
    return {"Cantitati Fatade": first, "Sumar": second, "Lista Cantitati": third[:-1]}


def write_workbooks(facades: DataFrame, elements: DataFrame, folder: str, key: str = "image_id") -> DataFrame:
    """A workbook for each project, as `workbook_sheets` has it; returns key,
    file and size. A repeated task writes the same bytes to the same name."""
    def write(own, parts):
        import pyarrow as pa
        from pyarrow import fs

        if not own.num_rows:
            return pa.table({key: own.column(key), "file": pa.array([], pa.string()), "bytes": pa.array([], pa.int64())})
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        project = str(own.column(key)[0].as_py())
        name = f"quantities-{quote(project, safe='')}.xlsx"
        data = xlsx(workbook_sheets(project, own.to_pylist(), parts.to_pylist()))
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
        return pa.table({key: own.column(key)[:1], "file": [name], "bytes": pa.array([len(data)], pa.int64())})

    return facades.groupBy(key).cogroup(elements.select(key, "facade_id", "element_id", "kind", "label", "area_m2").groupBy(key)).applyInArrow(write, f"{key} {facades.schema[key].dataType.simpleString()}, file string, bytes bigint")


def write_pages(images: DataFrame, folder: str, dpi: float = 254.0, tinted: bool = True) -> DataFrame:
    """A PDF page and a PNG picture of each image with its regions tinted, out
    of one stage over the pixels; returns image_id, file and size. Images that
    cannot be read are left out."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        from ..operators.detect import bgr_of, detect_all

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                image = bgr_of(row)
                if image is None:
                    continue
                found = [(kind, box[:4]) for kind, _, box in detect_all(image)] if tinted else []
                shown = overlay(image, found)
                for suffix, data in (("png", png(shown)), ("pdf", pdf(shown, dpi, f"{row['stem']}: {image.shape[1]} x {image.shape[0]} px"))):
                    name = f"{quote(row['stem'], safe='')}.{suffix}"
                    with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                        out.write(data)
                    rows.append((row["stem"], name, len(data)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["image_id", "file", "bytes"])

    return images.select("stem", "height", "width", "nChannels", "data").mapInArrow(run, "image_id string, file string, bytes long")


def write_yolo(lines: DataFrame, folder: str, names: tuple[str, ...] = ("facade", "window", "door", "socle")) -> None:
    """A label data set: one text table partitioned by split and image, from
    split, stem and line; and its description."""
    lines.select("split", "stem", "line").repartition("split", "stem").write.mode("errorifexists").partitionBy("split", "stem").text(f"{folder}/labels")
    head = [f"nc: {len(names)}", f"names: [{', '.join(names)}]", "train: images/train", "val: images/val"]
    lines.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/dataset")


def validation_split(images: DataFrame, share: float = 0.15, least: int = 3, seed: int = 42) -> DataFrame:
    """``stem`` and ``split``: the images with the smallest seeded hash are
    for validation, at least ``least``."""
    from pyspark.sql import functions as F

    n = images.select("stem").distinct().count()
    most = max(min(least, n), int(n * share))
    key = F.xxhash64("stem", F.lit(seed))
    cut = images.select("stem").distinct().orderBy(key, "stem").limit(most)
    return images.select("stem").distinct().join(cut.withColumn("split", F.lit("val")), "stem", "left").select("stem", F.coalesce("split", F.lit("train")).alias("split"))


def ground_truth_json(regions: DataFrame) -> DataFrame:
    """One JSON text for each image, in the dialect that is read as truth."""
    from pyspark.sql import functions as F

    boxes = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("label", F.array(*"xywh").alias("bbox"))))
    rows = regions.groupBy("image_id").agg(*(boxes(k).alias(f"{k}s") for k in ("facade", "window", "door", "socle")))
    return rows.select("image_id", F.to_json(F.struct(F.col("image_id").alias("sample_id"), *(F.array_sort(f"{k}s").alias(f"{k}s") for k in ("facade", "window", "door", "socle")))).alias("json"))


def overlay(bgr: np.ndarray, boxes: list[tuple[str, tuple[int, int, int, int]]], alpha: float = 0.35) -> np.ndarray:
    """The image with its regions tinted by kind and outlined."""
    colours = {"facade": (200, 160, 40), "window": (40, 200, 230), "door": (60, 90, 230), "socle": (160, 60, 160)}
    out = bgr.astype(np.float64)
    for kind, (x, y, w, h) in boxes:
        colour = np.array(colours.get(kind, (128, 128, 128)), float)
        x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, bgr.shape[1]), min(y + h, bgr.shape[0])
        if x1 > x0 and y1 > y0:
            out[y0:y1, x0:x1] = out[y0:y1, x0:x1] * (1 - alpha) + colour * alpha
            for edge in (np.s_[y0, x0:x1], np.s_[y1 - 1, x0:x1], np.s_[y0:y1, x0], np.s_[y0:y1, x1 - 1]):
                out[edge] = colour
    return np.rint(out).astype(np.uint8)


def png(bgr: np.ndarray) -> bytes:
    """An image as PNG bytes."""
    height, width = bgr.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(bgr[..., ::-1]).reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def png_dpi(data: bytes) -> float | None:
    """Resolution that a PNG states, where it is plausible."""
    at = 8
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at: at + 4], "big"), data[at + 4: at + 8]
        if kind == b"pHYs" and data[at + 16] == 1:
            x, y = (int.from_bytes(data[at + i: at + i + 4], "big") for i in (8, 12))
            dpi = (x + y) / 2 * 0.0254
            return dpi if 30 <= dpi <= 2400 else None
        if kind == b"IDAT":
            return None
        at += 12 + n
    return None


def texts(reports: DataFrame) -> Iterator[str]:
    """The texts of a small report table, for a driver that prints them."""
    return (r["text"] for r in reports.orderBy("image_id").toLocalIterator())
