"""Quantities of facades and projects.

Facades: image_id, facade_id, total_cm2, and optionally socle (cm2 left out of
the total), corner and socle_drip (cm). Elements: facade_id, kind (window or
door), w_cm, h_cm. Areas in cm2, lengths in cm, as whole numbers, so that sums
do not depend on their order; shown in m2 and m.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AREAS = ["total", "windows", "doors", "carpentry", "net", "socle", "gross", "reconstructed"]
LENGTHS = ["sill", "drip", "window_perimeter", "door_perimeter", "corner", "socle_drip"]


def _if(kind: str, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("long")


def element_sums(elements: DataFrame) -> DataFrame:
    """Sums by facade: partial sums on each task, one row a facade shuffled."""
    area, w, h = F.col("w_cm") * F.col("h_cm"), F.col("w_cm"), F.col("h_cm")
    return elements.groupBy("facade_id").agg(
        _if("window", area).alias("windows"), _if("door", area).alias("doors"),
        _if("window", F.lit(1)).alias("n_windows"), _if("door", F.lit(1)).alias("n_doors"),
        _if("window", w).alias("sill"), F.sum(w).cast("long").alias("drip"),
        _if("window", 2 * (w + h)).alias("window_perimeter"), _if("door", 2 * h + w).alias("door_perimeter"),
    )


def facade_report(facades: DataFrame, elements: DataFrame) -> DataFrame:
    """One row a facade: areas, linear quantities, counts. The net area never
    falls below 0; the gross area is the total with the socle. Facades without
    elements have zeros."""
    own = [c for c in ("socle", "corner", "socle_drip", "reconstructed") if c not in facades.columns]
    facades = facades.withColumns({c: F.lit(0).cast("long") for c in own}) if own else facades
    rows = facades.join(element_sums(elements), "facade_id", "left").na.fill(0, ["windows", "doors", "n_windows", "n_doors", *AREAS[5:6], *LENGTHS])
    rows = rows.withColumns({"carpentry": F.col("windows") + F.col("doors"), "gross": F.col("total_cm2") + F.col("socle")})
    return rows.withColumn("net", F.greatest(F.col("total_cm2") - F.col("carpentry"), F.lit(0))).withColumn("total", F.col("total_cm2"))


def shown(report: DataFrame, *keys: str) -> DataFrame:
    """Areas in m2 and lengths in m."""
    return report.select(
        *keys, *((F.col(c) / 10000.0).alias(f"{c}_m2") for c in AREAS), *((F.col(c) / 100.0).alias(f"{c}_m") for c in LENGTHS), "n_windows", "n_doors",
    )


def project_totals(report: DataFrame, key: str) -> DataFrame:
    """Sums over the facades of a project; net is the sum of clamped nets."""
    sums = [F.sum(c).cast("long").alias(c) for c in (*AREAS, *LENGTHS, "n_windows", "n_doors")]
    return report.groupBy(key).agg(F.count("*").alias("n_facades"), *sums)


def detail_rows(report: DataFrame, elements: DataFrame) -> DataFrame:
    """The rows of the detail sheet of each project: facades with their
    openings, a subtotal each, and the total, from one grouping."""
    lines = elements.join(report.select("facade_id", "image_id"), "facade_id").withColumn("area", F.col("w_cm") * F.col("h_cm"))
    sums = lines.groupingSets([[F.col("image_id"), F.col("facade_id"), F.col("kind")], [F.col("image_id"), F.col("facade_id")], [F.col("image_id")]], "image_id", "facade_id", "kind")
    sums = sums.agg(F.sum("area").cast("long").alias("area_cm2"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    level = F.col("level").cast("int")
    return sums.select("image_id", F.coalesce("facade_id", F.lit(-1)).alias("facade_id"), F.coalesce("kind", F.lit("all")).alias("kind"), level.alias("level"), "area_cm2", "n")


def with_fallback_parent(elements: DataFrame, facades: DataFrame) -> DataFrame:
    """Elements of an unknown facade go to the last facade of their image."""
    known = facades.select(F.col("image_id").alias("known_image"), F.col("facade_id").alias("known_id"))
    last = facades.groupBy("image_id").agg(F.max("facade_id").alias("last_id"))
    rows = elements.join(known, (F.col("image_id") == F.col("known_image")) & (F.col("facade_id") == F.col("known_id")), "left")
    return rows.join(last, "image_id", "left").withColumn("facade_id", F.coalesce("known_id", "last_id")).drop("known_image", "known_id", "last_id")


def with_missing_zones(report: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones (facade_id, zone_cm2) that were not drawn add to total and net."""
    extra = zones.groupBy("facade_id").agg(F.sum("zone_cm2").cast("long").alias("reconstructed"))
    rows = report.drop("reconstructed").join(extra, "facade_id", "left").na.fill(0, ["reconstructed"])
    rows = rows.withColumns({"total": F.col("total") + F.col("reconstructed"), "gross": F.col("gross") + F.col("reconstructed")})
    return rows.withColumn("net", F.greatest(F.col("total") - F.col("carpentry"), F.lit(0)))


#: Sections of the quantities list, and its lines in order with
#: the total that each shows (m2 or m); lines without one show 0, as they are
#: filled in by hand.
SECTIONS = {1: "1. SUPRAFEȚE PRINCIPALE", 2: "2. FERESTRE", 3: "3. UȘI", 4: "4. ELEMENTE PERIMETRALE", 5: "TOTAL"}
QUANTITY_LINES = [
    (1, 1, "Pod termoizolat", None, "mp"), (1, 2, "Fațade total", "total", "mp"), (1, 3, "Fațade fără goluri (termosistem)", "net", "mp"),
    (1, 4, "Vată minerală coșuri de fum", None, "mp"),
    (2, 1, "Suprafață ferestre", "windows", "mp"), (2, 2, "Ferestre de înlocuit", "windows", "mp"), (2, 3, "Perimetru ferestre", "window_perimeter", "ml"),
    (2, 4, "Glaf exterior", "sill", "ml"), (2, 5, "Glaf interior", "sill", "ml"), (2, 6, "Colțare ferestre", "corner", "ml"),
    (2, 7, "Profil picurător ferestre", "sill", "ml"), (2, 8, "Șpaleți ferestre", None, "mp"),
    (3, 1, "Suprafață uși", "doors", "mp"), (3, 2, "Uși de înlocuit", "doors", "mp"), (3, 3, "Perimetru uși", "door_perimeter", "ml"),
    (3, 4, "Colțare uși", None, "ml"), (3, 5, "Profil picurător uși", None, "ml"), (3, 6, "Șpaleți uși", None, "mp"),
    (4, 1, "Profil picurător soclu", "socle_drip", "ml"), (4, 2, "Colțar exterior", None, "ml"), (4, 3, "Finisaj interior", None, "mp"),
    (5, 1, "TOTAL goluri (uși + ferestre)", "carpentry", "mp"),
]


def hundredths(area: Column) -> Column:
    """Areas in cm2 as whole hundredths of m2, halves upwards."""
    return F.floor((area + 50) / 100)


def quantities_list(totals: DataFrame, key: str) -> DataFrame:
    """The list of a project's quantities, one row a line."""
    shown = lambda c, u: F.lit(0.0) if c is None else (hundredths(F.col(c)) if u == "mp" else F.col(c)) / 100.0
    lines = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(o).alias("line"), F.lit(t).alias("label"), F.lit(u).alias("unit"), shown(c, u).alias("quantity")) for s, o, t, c, u in QUANTITY_LINES))
    return totals.select(key, F.explode(lines).alias("l")).select(key, "l.*")


def summary_text(report: DataFrame, key: str) -> DataFrame:
    """The report of a project as text, a line for each facade."""
    two = lambda c: (F.floor(hundredths(F.col(c)) / 100), hundredths(F.col(c)) % 100)
    line = F.format_string("%s: total %d.%02d m2, carpentry %d.%02d m2, net %d.%02d m2", F.col("name"), *two("total"), *two("carpentry"), *two("net"))
    rows = F.array_sort(F.collect_list(F.struct("facade_id", line.alias("line"))))
    return report.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def propagated_areas(elements: DataFrame) -> DataFrame:
    """Missing areas from the median of like labels: ``area_cm2`` null where
    unknown; group by image_id, kind and ``key``."""
    like = Window.partitionBy("image_id", "kind", "key")
    return elements.withColumn("area_m2", F.coalesce(F.col("area_cm2") / 10000.0, F.median("area_cm2").over(like) / 10000.0))


#: Lines of a facade in the report's text, with what they show;
#: those of areas before the sums and of lengths behind them.
FACADE_LENGTHS = [("Glaf exterior", "sill"), ("Picurator goluri", "drip"), ("Lungime coltare", "corner"), ("Picurator soclu", "socle_drip"), ("Perimetru ferestre", "window_perimeter"), ("Perimetru usi", "door_perimeter")]
PROJECT_AREAS = [("Suprafata bruta fatade", "gross"), ("Suprafata fatade (fara soclu)", "total"), ("Total ferestre", "windows"), ("Total usi", "doors"), ("Total tamplarie", "carpentry"), ("TOTAL TERMOSISTEM", "net")]
PROJECT_EXTRAS = [("TOTAL SOCLU EXCLUS", "socle"), ("TOTAL COMPLETARE ASISTATA", "reconstructed")]
PROJECT_LENGTHS = [("TOTAL GLAF EXTERIOR", "sill"), ("TOTAL PICURATOR GOLURI", "drip"), ("TOTAL LUNGIME COLTARE", "corner"), ("TOTAL PICURATOR SOCLU", "socle_drip"), ("TOTAL PERIMETRU FERESTRE", "window_perimeter"), ("TOTAL PERIMETRU USI", "door_perimeter")]


def thousandths(amount: Column) -> Column:
    """A whole number of thousandths as text with three decimals."""
    return F.concat(F.floor(amount / 1000).cast("string"), F.lit("."), F.lpad((amount % 1000).cast("string"), 3, "0"))


def report_text(report: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """The whole report of a project as text: each facade with its openings,
    the sums and how the net area comes about, and the project's totals.

    Areas in cm2 are shown in m2, lengths in cm in m, with three decimals,
    halves upwards; lines are ``label: value unit``.
    """
    area = lambda c: thousandths(F.floor((c + 5) / 10).cast("long"))
    length = lambda c: thousandths((c * 10).cast("long"))
    line = lambda label, c, show, unit: F.concat(F.lit(f"  {label}: "), show(c), F.lit(f" {unit}"))
    areas = lambda pairs: [line(t, F.col(c), area, "m²") for t, c in pairs]
    lengths = lambda pairs: [line(t, F.col(c), length, "m") for t, c in pairs]
    own = elements.select("facade_id", "kind", "element_id", F.concat(F.lit("    - "), F.coalesce("label", F.lit("")), F.lit(" "), area(F.col("w_cm") * F.col("h_cm")), F.lit(" m²")).alias("line"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("element_id", "line")))), lambda x: x["line"]).alias(f"{kind}_lines")
    rows = report.join(own.groupBy("facade_id").agg(listed("window"), listed("door")), "facade_id", "left")
    some = lambda on, *lines: F.when(on, F.array(*lines)).otherwise(F.array().cast("array<string>"))
    has_socle = F.col("socle") > 0
    formula = F.concat(
        F.lit("  Formula net: "), F.when(has_socle, F.concat(F.lit("("), area(F.col("gross")), F.lit(" - "), area(F.col("socle")), F.lit(")"))).otherwise(area(F.col("total"))),
        F.lit(" - "), area(F.col("carpentry")), F.lit(" = "), area(F.col("net")), F.lit(" m²"),
    )
    block = F.concat(
        some(has_socle, *areas([("Fatada bruta", "gross"), ("Soclu exclus", "socle")])), F.array(*areas([("Suprafata fatada (fara soclu)", "total")])),
        some(F.col("reconstructed") > 0, *areas([("Completare asistata", "reconstructed")])),
        F.when(F.col("n_windows") > 0, F.concat(F.array(F.lit("  Ferestre:")), F.col("window_lines"), F.array(*areas([("Total ferestre", "windows")])))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("n_doors") > 0, F.concat(F.array(F.lit("  Usi:")), F.col("door_lines"), F.array(*areas([("Total usi", "doors")])))).otherwise(F.array().cast("array<string>")),
        F.array(*areas([("Total tamplarie", "carpentry"), ("TERMOSISTEM (net)", "net")]), formula, *lengths(FACADE_LENGTHS)),
    )
    facade = F.struct("facade_id", F.col("name").alias("name"), F.array_join(block, "\n").alias("body"))
    sums = [F.sum(c).cast("long").alias(c) for c in (*AREAS, *LENGTHS)]
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(facade)).alias("fs"), *sums)
    blocks = F.transform("fs", lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f["name"], F.lit("\n"), f["body"]))
    whole = F.concat(
        F.lit("  Formula total net: ("), area(F.col("gross")), F.lit(" - "), area(F.col("socle")), F.lit(") - "), area(F.col("carpentry")), F.lit(" = "), area(F.col("net")), F.lit(" m²"),
    )
    end = F.array(F.lit("TOTALURI PROIECT"), *areas(PROJECT_AREAS), whole, *areas(PROJECT_EXTRAS), *lengths(PROJECT_LENGTHS))
    return grouped.select(key, F.concat_ws("\n\n", F.lit("RAPORT CANTITATI"), F.array_join(blocks, "\n\n"), F.array_join(end, "\n")).alias("text"))
