"""Catalogs of trajectories, their frames, and the builder that brings new frame files into them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statewise.functions.vectors import integer_component, natural_key

SCHEMA = "traj_id long, path string, length int, errors string, converted_from array<string>"
FRAMES = "traj_id long, frame long, xyz array<array<double>>"


def valid(catalog: DataFrame) -> DataFrame:
    """The trajectories without an error message, with a dense ``index`` from 0 in ``traj_id`` order (one row per trajectory is ranked)."""
    w = Window.orderBy("traj_id")
    return catalog.where(F.col("errors").isNull()).withColumn("index", (F.row_number().over(w) - 1).cast("long"))


class Catalog:
    """A catalog (one row per trajectory) with its frames (``traj_id, frame, xyz``) and reference structure (one row per atom)."""

    def __init__(self, catalog: DataFrame, frames: DataFrame | None = None, atoms: DataFrame | None = None):
        missing = {"traj_id", "length", "errors"} - set(catalog.columns)
        if missing:
            raise ValueError(f"the catalog lacks {sorted(missing)}")
        self.catalog, self.frames, self.atoms = catalog, frames, atoms

    @classmethod
    def load(cls, spark: SparkSession, path: str, frames: str | None = None, atoms: str | None = None) -> Catalog:
        """By suffix: .parquet, .json, or .yaml (the block layout ``trajs:`` with one ``key: value`` per line); others are refused."""
        if path.endswith(".parquet"):
            table = spark.read.parquet(path)
        elif path.endswith(".json"):
            table = spark.read.schema(SCHEMA).json(path)
        elif path.endswith((".yaml", ".yml")):
            table = read_yaml(spark, path)
        else:
            raise ValueError(f"{path}: not a .parquet, .json or .yaml catalog")
        return cls(table, spark.read.parquet(frames) if frames else None, spark.read.parquet(atoms) if atoms else None)

    def save(self, path: str) -> None:
        """Write the catalog as parquet or json by suffix; an existing target is an error."""
        writer = self.catalog.write.mode("errorifexists")
        if path.endswith(".json"):
            writer.json(path)
        else:
            writer.parquet(path if path.endswith(".parquet") else path + ".parquet")

    def n_trajs(self) -> DataFrame:
        return self.catalog.where("errors is null").agg(F.count(F.lit(1)).alias("n_trajs"))

    def lengths(self) -> DataFrame:
        return valid(self.catalog).select("index", "traj_id", "length")

    def same_as(self, other: Catalog) -> bool:
        """Equal by base name, length and message, in any order."""

        def rows(c: DataFrame) -> DataFrame:
            return c.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "errors")

        a, b = rows(self.catalog), rows(other.catalog)
        return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()

    def shapes(self) -> DataFrame:
        """``traj_id, n_frames, n_atoms`` as stored."""
        return self.frames.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_frames"), F.max(F.size("xyz")).alias("n_atoms"))

    def problems(self) -> DataFrame:
        """``traj_id, problem`` of valid trajectories without frames, with another number of frames than listed, or with odd atom counts."""
        shapes = self.shapes()
        common = shapes.groupBy("n_atoms").count().orderBy(F.desc("count"), "n_atoms").limit(1).select(F.col("n_atoms").alias("_most"))
        rows = valid(self.catalog).select("traj_id", "length").join(shapes, "traj_id", "left").crossJoin(F.broadcast(common))
        problem = F.when(F.col("n_frames").isNull(), "no frames").when(~F.col("n_frames").eqNullSafe(F.col("length").cast("long")), "length").when(F.col("n_atoms") != F.col("_most"), "atoms")
        return rows.withColumn("problem", problem).where("problem is not null").select("traj_id", "problem")

    def load_traj(self, index: int, stride: int = 1, atoms: list[int] | None = None) -> DataFrame:
        """Frames of the ``index``-th valid trajectory, every ``stride``-th, with the listed atoms only; the filter on the trajectory
        reaches the scan."""
        row = valid(self.catalog).where(F.col("index") == index).select("traj_id").first()
        if row is None:
            raise ValueError(f"no valid trajectory {index}")
        rows = self.frames.where((F.col("traj_id") == row[0]) & (F.col("frame") % stride == 0))
        return rows if atoms is None else rows.withColumn("xyz", pick_atoms(F.col("xyz"), atoms))

    def load_frames(self, wanted: list[tuple[int, int]]) -> DataFrame:
        """``ord, traj_id, frame, xyz`` of (valid trajectory, frame) pairs in the order asked, repeats included; a frame that is not
        stored has a null ``xyz``."""
        spark = self.catalog.sparkSession
        asked = spark.createDataFrame([(k, i, f) for k, (i, f) in enumerate(wanted)], "ord int, index long, frame long")
        keyed = asked.join(valid(self.catalog).select("index", "traj_id"), "index", "left")
        once = self.frames.dropDuplicates(["traj_id", "frame"])
        return once.join(F.broadcast(keyed), ["traj_id", "frame"], "right").select("ord", "traj_id", "frame", "xyz").orderBy("ord")

    def empty_traj(self) -> DataFrame:
        return self.catalog.sparkSession.createDataFrame([], FRAMES)


def pick_atoms(xyz: Column, atoms: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(a) for a in atoms]), lambda a: F.get(xyz, a))


def atom_selection(atoms: DataFrame, kind: str) -> DataFrame:
    """Atoms of a kind: ``all``, ``heavy`` (no hydrogen), ``alpha`` (CA), ``minimal`` (backbone N, CA, C, O, CB and no caps)."""
    name = F.col("name")
    if kind == "all":
        return atoms
    if kind == "heavy":
        return atoms.where(~name.rlike(r"^\d*H"))
    if kind == "alpha":
        return atoms.where(name == "CA")
    if kind == "minimal":
        return atoms.where(name.isin("N", "CA", "C", "O", "CB"))
    raise ValueError(f"unknown kind of atoms {kind!r}")


# Text formats.


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A block-style YAML catalog: list items under ``trajs``, their keys ``id``, ``path``, ``length``, ``errors``, ``converted_from``."""
    text = F.regexp_replace("value", r"\r", "")
    items = spark.read.text(path, wholetext=True).select(F.explode(F.split(text, r"\n\s*-\s+(?=\w+\s*:)")).alias("t")).where(F.col("t").rlike(r"(?m)^\s*(id|path)\s*:"))

    def field(name: str) -> Column:
        return F.nullif(F.nullif(F.trim(F.regexp_extract("t", rf"(?m)^\s*{name}\s*:[ \t]*[\"']?([^\"'\n]*)", 1)), F.lit("null")), F.lit(""))

    listed = F.regexp_extract_all("t", F.lit(r"(?m)^\s+-\s+[\"']?([^\"'\n]+)"), F.lit(1))
    rows = items.select(F.coalesce(field("id").try_cast("long"), F.monotonically_increasing_id()).alias("traj_id"), field("path").alias("path"), field("length").try_cast("int").alias("length"), field("errors").alias("errors"), listed.alias("converted_from"))
    return rows.where("path is not null")


def read_mtx(spark: SparkSession, path: str, value: str = "c") -> DataFrame:
    """MatrixMarket coordinates as ``i, j, value`` (0-based); a symmetric file gives both triangles."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.trim("value").alias("t"), place.alias("_at"))
    symmetric = bool(lines.where(F.col("t").startswith("%%") & F.lower("t").contains("symmetric")).limit(1).count())
    parts = lines.where(~F.col("t").startswith("%") & (F.col("t") != "")).select(F.split("t", r"\s+").alias("p"), "_at")
    header = parts.agg(F.min_by("p", "_at").alias("p")).first()["p"]
    if header is None:
        raise ValueError(f"{path} has no size line")
    rows = parts.where((F.size("p") == 3) & ~(F.array_join("p", " ") == " ".join(header)))
    out = rows.select((F.col("p")[0].cast("int") - 1).alias("i"), (F.col("p")[1].cast("int") - 1).alias("j"), F.col("p")[2].cast("double").alias(value))
    return out.unionByName(out.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), value)) if symmetric else out


def write_mtx(entries: DataFrame, value: str, n: int, path: str) -> None:
    """``i, j, value`` as one MatrixMarket file of coordinates, the header first (a model's matrix: its entries are bounded by the states a model may have)."""
    spark = entries.sparkSession
    rows = entries.where(F.col(value) != 0)
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{n} {n} {rows.count()}",)], "value string").coalesce(1)
    head.unionByName(rows.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col(value)).alias("value"))).coalesce(1).write.mode("errorifexists").text(path)


def read_dat(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """White-space separated numbers, one row per line, with the row's number ``i`` where one column is asked."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("_m"))
    values = [F.col("p")[k].cast("double").alias(n) for k, n in enumerate(columns)]
    if len(columns) > 1:
        return lines.select(*values)
    return lines.select((F.row_number().over(Window.orderBy("_m")) - 1).alias("i"), *values)


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM rows of a PDB file as ``atom, name, residue, resid, x, y, z`` in nm."""
    t = F.col("value")
    rows = spark.read.text(path).where(t.rlike("^(ATOM|HETATM)"))

    def part(a: int, n: int) -> Column:
        return F.trim(F.substring(t, a, n))

    return rows.select((part(7, 5).cast("int") - 1).alias("atom"), part(13, 4).alias("name"), part(18, 4).alias("residue"), part(23, 4).cast("int").alias("resid"), *[(part(31 + 8 * k, 8).cast("double") / 10).alias(n) for k, n in enumerate("xyz")])


# Building a catalog from files of frames.


def listing(files: DataFrame) -> DataFrame:
    """``path, run, clone, gen, location, ord``: the parts of ``.../RUNr/CLONEc/frameg.ext`` paths (null where absent), the folder, and the
    file's rank in natural order within its folder."""
    path = F.regexp_replace("path", r"/+", "/")
    rows = files.where("path is not null").select(path.alias("path"))
    rows = rows.select("path", F.regexp_extract("path", r"RUN(\d+)", 1).try_cast("int").alias("run"), F.regexp_extract("path", r"CLONE(\d+)", 1).try_cast("int").alias("clone"), integer_component(F.element_at(F.split("path", "/"), -1)).alias("gen"), F.regexp_replace("path", r"/?[^/]*$", "").alias("location"))
    w = Window.partitionBy("location").orderBy(natural_key(F.col("path")), "path")
    return rows.withColumn("ord", F.row_number().over(w) - 1)


def until_gap(files: DataFrame) -> DataFrame:
    """Files of each location up to the first gap in their numbers."""
    w = Window.partitionBy("location").orderBy("gen", "path")
    rows = files.withColumn("_k", F.col("gen") - F.min("gen").over(Window.partitionBy("location")) - F.row_number().over(w) + 1)
    return rows.where("_k = 0").drop("_k")


def drop_overlap(frames: DataFrame, features: str = "xyz", tolerance: float = 1e-8) -> DataFrame:
    """Concatenated pieces (``traj_id, piece, frame``) without a piece's first frame where it repeats the last one before it, renumbered.

    Only the first and last frame of each piece meet; the frame numbers are running counts over pieces."""
    ends = frames.groupBy("traj_id", "piece").agg(F.min_by(features, "frame").alias("_first"), F.max_by(features, "frame").alias("_last"), F.count(F.lit(1)).alias("_n"), F.min("frame").alias("_f0"))
    w = Window.partitionBy("traj_id").orderBy("piece")
    apart = F.aggregate(F.zip_with(F.flatten(F.col("_first")), F.flatten(F.lag("_last").over(w)), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    ends = ends.withColumn("_same", F.coalesce(apart < tolerance, F.lit(False)).cast("int"))
    ends = ends.withColumn("_at", F.coalesce(F.sum(F.col("_n") - F.col("_same")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = frames.join(ends.select("traj_id", "piece", "_same", "_at", "_f0"), ["traj_id", "piece"]).where((F.col("_same") == 0) | (F.col("frame") > F.col("_f0")))
    return rows.withColumn("frame", F.col("_at") + F.col("frame") - F.col("_f0") - F.col("_same")).drop("_same", "_at", "_f0")


def new_locations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path no catalog row was converted from."""
    return found.join(known.select(F.explode("converted_from").alias("path")).distinct(), "path", "left_anti")


Validator = Callable[[DataFrame], DataFrame]


def too_short(least: int) -> Validator:
    """Trajectories with fewer than ``least`` frames."""
    return lambda frames: frames.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("traj_id", F.format_string("TooLittleData: %d frames < %d", "n", F.lit(least)).alias("errors"))


def exploded(distances: DataFrame, most: float) -> Validator:
    """Trajectories with a frame farther than ``most`` from the reference; ``distances`` has ``traj_id, dist``."""
    return lambda _: distances.groupBy("traj_id").agg(F.max("dist").alias("m")).where(F.col("m") > most).select("traj_id", F.format_string("Explosion: %.4f", "m").alias("errors"))


def validate(catalog: DataFrame, frames: DataFrame, validators: list[Validator]) -> DataFrame:
    """The catalog with the message of the first validator that rejects a trajectory; messages it already has stay."""
    for v in validators:
        if not callable(v):
            raise TypeError("a validator must be callable")
        found = v(frames).withColumnRenamed("errors", "_e")
        catalog = catalog.join(found, "traj_id", "left").withColumn("errors", F.coalesce("errors", "_e")).drop("_e")
    return catalog


def build(known: DataFrame, pieces: DataFrame, validators: list[Validator] | None = None, stride: int = 1, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, new frames) after an ingest: ``pieces`` has ``location, piece, path, frame, xyz``; files that ``known`` was converted from are
    left out.

    Locations new to ``known`` get ids after its largest, in natural order. Further files of a known location (its ``path``) make that
    trajectory grow: their frames follow its ``length``, and if ``stored`` (``traj_id, frame, xyz``, the frames so far) is given, a first
    frame that repeats the last stored one is dropped. Overlapping piece borders are dropped, every ``stride``-th frame is kept, and
    validators look at the new frames of trajectories without errors.
    """
    names = ["traj_id", "path", "length", "errors", "converted_from"]
    fresh = new_locations(pieces, known)
    base = known.select(F.col("path").alias("location"), "traj_id", F.col("length").cast("long").alias("_base"))
    there = fresh.join(base, "location", "left")
    top = known.agg(F.coalesce(F.max("traj_id"), F.lit(-1)).alias("t"))
    places = there.where("traj_id is null").select("location").distinct().withColumn("_k", F.row_number().over(Window.orderBy(natural_key(F.col("location")), "location")))
    ids = places.crossJoin(F.broadcast(top)).select("location", (F.col("t") + F.col("_k")).alias("_id"))
    keyed = there.join(ids, "location", "left").withColumn("traj_id", F.coalesce("traj_id", "_id")).drop("_id")
    rows = keyed.select("traj_id", "piece", "frame", "xyz")
    starts = keyed.groupBy("traj_id").agg(F.max("_base").alias("_base"))
    if stored is not None:
        grown = keyed.where("_base is not null").groupBy("traj_id").agg((F.min("piece") - 1).alias("piece"))
        last = stored.join(grown, "traj_id").groupBy("traj_id", "piece").agg(F.max_by("xyz", "frame").alias("xyz")).select("traj_id", "piece", F.lit(0).cast(dict(rows.dtypes)["frame"]).alias("frame"), "xyz")
        rows = rows.unionByName(last)
        starts = starts.join(last.select("traj_id", F.lit(1).alias("_one")), "traj_id", "left").withColumn("_one", F.coalesce("_one", F.lit(0)))
    else:
        starts = starts.withColumn("_one", F.lit(0))
    placed = drop_overlap(rows).join(starts, "traj_id").withColumn("frame", F.col("frame") - F.col("_one")).where(F.col("frame") >= 0)
    frames = placed.where(F.col("frame") % stride == 0).select("traj_id", (F.coalesce("_base", F.lit(0)) + F.floor(F.col("frame") / stride)).alias("frame"), "xyz")
    sizes = frames.groupBy("traj_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    sources = keyed.groupBy("traj_id").agg(F.first("location").alias("_path"), F.array_sort(F.collect_set("path")).alias("_from")).join(sizes, "traj_id", "left")
    both = known.select(*names).join(sources, "traj_id", "full")
    both = both.select(
        "traj_id", F.coalesce("path", "_path").alias("path"), F.when(F.col("_from").isNull(), F.col("length")).otherwise(F.coalesce("length", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int").alias("length"),
        "errors", F.when(F.col("_from").isNull(), F.col("converted_from")).otherwise(F.concat(F.coalesce("converted_from", F.array().cast("array<string>")), "_from")).alias("converted_from"),
    )
    return validate(both, frames, validators or []).select(*names), frames


def random_frames(spark: SparkSession, lengths: list[int], atoms: int, seed: int = 0) -> DataFrame:
    """Trajectories of normal random coordinates, for tests of layouts."""
    rows = spark.createDataFrame(list(enumerate(lengths)), "traj_id long, n int").where("n > 0").select("traj_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))).alias("frame"))
    point = F.array(*[F.array(*[F.randn(seed + 3 * a + k) for k in range(3)]) for a in range(atoms)])
    return rows.select("traj_id", "frame", point.alias("xyz"))
