"""Readers: PSM files, experiments, FASTA, node and final tables, sample, group and mutation lists."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquant.functions.ratios import log2_of_ratio, nan
from netquant.functions.texts import unescaped_number
from netquant.operators.datasets import split_keys, within_fdr

PSM_SCHEMA = "psm_id string, peptide_key string, ratio double, weight double, protein_acc string"
# Headers of the peptide-node table (fixed values), by the column they become.
NODE_HEADERS = {
    "site_key": "Node key", "sequences": "Sequence", "proteins": "Protein(s)", "genes": "Genes",
    "log2_ratio": "Log2Ratio", "sd": "Ratio STDEV", "score": "Ratio Score Value",
    "n_meas": "Num Measurements", "n_psm": "Num PSMs", "n_pep": "Num Peptides",
}
# Headers of the final table (fixed values).
FINAL_HEADERS = {"peptide_node": "peptideNodeID", "protein": "ACCs"}


def read_psm_tsv(spark: SparkSession, paths: str | Sequence[str], sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """``(psm, psm_protein)`` of header-less files with one row per PSM and protein."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.schema(PSM_SCHEMA).csv(
        paths, sep=sep, nanValue="NaN", positiveInf="Infinity", negativeInf="-Infinity"
    )
    psm = rows.groupBy("psm_id").agg(
        F.min("peptide_key").alias("peptide_key"), F.min("ratio").alias("ratio"), F.min("weight").alias("weight")
    )
    return psm.withColumn("log2_ratio", log2_of_ratio("ratio")), rows.select("psm_id", "protein_acc").distinct()


def parse_experiments(text: str) -> dict[str, list[str]]:
    """``exp1[rep1,rep2] | exp2[rep3]`` as experiment -> replicates; a repeated replicate is an error."""
    found: dict[str, list[str]] = {}
    seen: set[str] = set()
    for part in text.split("|"):
        match = re.fullmatch(r"\s*([^\[\]]+?)\s*\[([^\[\]]*)\]\s*", part)
        if match is None:
            raise ValueError(f"experiment[replicate, ...] expected, got {part!r}")
        for replicate in (r.strip() for r in match[2].split(",") if r.strip()):
            if replicate in seen:
                raise ValueError(f"replicate {replicate!r} is named twice")
            seen.add(replicate)
            found.setdefault(match[1], []).append(replicate)
    return found


def _plain(uri: str) -> str:
    """One form for ``file:/x`` and ``file:///x``."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", uri)


def _escaped(path: str) -> str:
    """A found path as a reader's argument: signs of glob patterns stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def claimed_files(spark: SparkSession, claims: Sequence[tuple[str, str]]) -> dict[str, str]:
    """File -> name for the files of ``(name, path)`` claims; a path is a file, a folder with all below it, or a pattern.

    A file below several claims goes to the longest path. An error if a pattern finds nothing, a folder holds no file or two names claim one path.
    """
    roots: dict[str, str] = {}
    for name, path in claims:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            root = _plain(status.getPath().toUri().toString())
            if roots.setdefault(root, name) != name:
                raise ValueError(f"{root} is named by {roots[root]!r} and {name!r}")
    # A folder inside another one is listed with it.
    tops = [root for root in roots if not any(root[:at] in roots for at in _cuts(root))]
    listed = spark.read.option("recursiveFileLookup", True).text([_escaped(unquote(root)) for root in tops]).inputFiles()
    files = {}
    for file in map(_plain, listed):
        owner = next(root for root in (file, *(file[:at] for at in _cuts(file))) if root in roots)
        files[file] = roots[owner]
    empty = {name for name, _ in claims} - set(files.values())
    if empty:
        raise FileNotFoundError(f"no files for {sorted(empty)}")
    return files


def _cuts(path: str) -> list[int]:
    """Where the parents of a path end, the longest first."""
    return [m.start() for m in re.finditer("/", path)][::-1]


def scanned_file() -> Column:
    """The scan's file in the form of :func:`claimed_files`."""
    return F.regexp_replace("_metadata.file_path", r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def file_paths(files: Sequence[str]) -> list[str]:
    """Claimed files as the argument of a reader."""
    return [_escaped(unquote(file)) for file in files]


def read_experiments(spark: SparkSession, files: Mapping[str, Mapping[str, str]], sep: str = "\t") -> DataFrame:
    """Rows of all replicates with experiment and replicate.

    ``files`` is experiment -> replicate -> path: a file, a folder or a glob pattern. All files are one scan, and a join on the file's
    path names the rows, so the plan does not grow with replicates or files and equal file names in different folders stay apart.
    A file under two replicates' paths belongs to the longer path; see :func:`claimed_files` for errors.
    """
    named = [(experiment, replicate, path) for experiment, paths in files.items() for replicate, path in paths.items()]
    repeated = [replicate for replicate, n in Counter(replicate for _, replicate, _ in named).items() if n > 1]
    if repeated:
        raise ValueError(f"replicates named twice: {repeated}")
    experiment_of = {replicate: experiment for experiment, replicate, _ in named}
    found = claimed_files(spark, [(replicate, path) for _, replicate, path in named])
    names = spark.createDataFrame(
        [(file, experiment_of[replicate], replicate) for file, replicate in found.items()], "_file string, experiment string, replicate string"
    )
    rows = spark.read.schema(PSM_SCHEMA).csv(
        file_paths(list(found)), sep=sep, nanValue="NaN", positiveInf="Infinity", negativeInf="-Infinity"
    )
    return rows.withColumn("_file", scanned_file()).join(names, "_file").drop("_file").withColumn("log2_ratio", log2_of_ratio("ratio"))


def merge_identifications(
    quant: DataFrame, quant_proteins: DataFrame, ident: DataFrame, ident_proteins: DataFrame, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Quantified PSMs and, for ids they lack, identified ones with a NaN ratio; proteins of both.

    Ids that exist keep their quantified row, so this is a union with the unmatched rest: no wide
    outer join.
    """
    key = [*by, "psm_id"]
    new = ident.join(quant.select(*key), key, "left_anti")
    rows = new.select(
        *[
            F.col(c) if c in ident.columns else (nan() if c == "log2_ratio" else F.lit(None)).cast(quant.schema[c].dataType).alias(c)
            for c in quant.columns
        ]
    )
    return quant.unionByName(rows), quant_proteins.unionByName(ident_proteins).distinct()


def fasta_accession(header):
    """UniProt accession of a header, else the second bar field of sp/tr, else the first word."""
    reverse = header.rlike("(?i)^(reverse|contaminant)")
    uniprot = F.regexp_extract(
        header, r"([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})", 1
    )
    barred = F.regexp_extract(header, r"(?:sp|tr)\|([^|\s]+)", 1)
    word = F.regexp_extract(header, r"^(\S+)", 1)
    return F.when(reverse, word).when(uniprot != "", uniprot).when(barred != "", barred).otherwise(word)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(protein_acc, header, sequence)``; records are split by the reader, so large files are read in parallel."""
    lines = spark.read.text(path, lineSep="\n>")
    records = lines.select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim("value") != "")
    header = F.trim(F.split("value", "\r?\n", 2)[0])
    body = F.regexp_replace(F.coalesce(F.get(F.split("value", "\r?\n", 2), 1), F.lit("")), r"\s", "")
    return records.select(fasta_accession(header).alias("protein_acc"), header.alias("header"), body.alias("sequence"))


def read_node_table(spark: SparkSession, path: str | Sequence[str], sample: str) -> DataFrame:
    """Site rows of one sample's peptide-node table, columns found by header name."""
    return _sites(spark.read.csv(path, sep="\t", header=True), F.lit(sample))


def _sites(raw: DataFrame, sample: Column) -> DataFrame:
    have = {c.strip(): c for c in raw.columns}

    def text(name: str):
        header = NODE_HEADERS[name]
        return F.col(f"`{have[header]}`") if header in have else F.lit(None).cast("string")

    sd = unescaped_number(text("sd")) if NODE_HEADERS["sd"] in have else nan()
    spread = F.when(F.isnan(sd), unescaped_number(text("score"))).otherwise(sd)
    return raw.select(
        text("site_key").alias("site_key"), sample.alias("sample"), text("sequences").alias("sequences"),
        text("proteins").alias("proteins"), text("genes").alias("genes"),
        unescaped_number(text("log2_ratio")).alias("log2_ratio"), spread.alias("sd"),
        *[F.coalesce(text(c).try_cast("int"), F.lit(0)).alias(c) for c in ("n_meas", "n_psm", "n_pep")],
    )


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """``(sample, path, swap)`` of a tab-separated sample list."""
    rows = spark.read.schema("sample string, path string, flag string").csv(path, sep="\t", comment="#")
    return rows.select(F.trim("sample").alias("sample"), F.trim("path").alias("path"), (F.upper(F.trim(F.coalesce("flag", F.lit("")))) == "SWAP").alias("swap"))


def node_table_path(path: str) -> str:
    """A sample's table: a file as given, or the folder's one peptideNodeTable file by pattern."""
    return path if re.search(r"\.(txt|tsv|csv)$", path) else f"{path.rstrip('/')}/*peptideNodeTable*"


def read_samples(spark: SparkSession, sample_list: DataFrame) -> DataFrame:
    """Sites of all samples of a list, label-swapped ones turned.

    The list names files, so it is small. Files with the same header line are one scan whose rows a join on the file's path names:
    the plan grows with the number of different headers, not of samples. An error for a file without a header line
    (one with the field ``Node key``) and for a sample named twice.
    """
    listed = sample_list.collect()
    swapped = {row["sample"]: bool(row["swap"]) for row in listed}
    if len(swapped) < len(listed):
        raise ValueError("a sample is named twice")
    found = claimed_files(spark, [(row["sample"], node_table_path(row["path"])) for row in listed])
    names = spark.createDataFrame([(file, sample, swapped[sample]) for file, sample in found.items()], "_file string, _sample string, _swap boolean")
    lines = spark.read.text(file_paths(list(found))).withColumn("_file", scanned_file())
    fields = F.transform(F.split("value", "\t"), lambda field: F.trim(field, F.lit(' "')))
    headers = lines.filter(F.array_contains(fields, NODE_HEADERS["site_key"])).select("_file", "value").distinct().collect()  # one row per file
    layouts: dict[str, list[str]] = {}
    for row in headers:
        layouts.setdefault(row["value"], []).append(row["_file"])
    bare = set(found) - {row["_file"] for row in headers}
    if bare:
        raise ValueError(f"no header line in {sorted(bare)}")

    def scan(files: list[str]) -> DataFrame:
        raw = spark.read.csv(file_paths(files), sep="\t", header=True)
        named = raw.withColumn("_file", scanned_file()).join(names, "_file")
        turned = {c: -unescaped_number(f"`{c}`") for c in raw.columns if c.strip() == NODE_HEADERS["log2_ratio"]}
        turned = {c: F.when(F.col("_swap"), value).otherwise(unescaped_number(f"`{c}`")).cast("string") for c, value in turned.items()}
        return _sites(named.withColumns(turned) if turned else named, F.col("_sample"))

    return reduce(DataFrame.unionByName, [scan(sorted(files)) for _, files in sorted(layouts.items())])


def read_final_table(spark: SparkSession, path: str, fdr_max: float, key_kind: str = "peptide_node") -> DataFrame:
    """``(key, fdr, log2_ratio)`` of a final table within the FDR; columns by name, composite keys split."""
    raw = spark.read.csv(path, sep="\t", header=True)
    rows = raw.select(
        F.col(FINAL_HEADERS[key_kind]).alias("key"), unescaped_number("FDR").alias("fdr"),
        unescaped_number("log2Ratio").alias("log2_ratio"),
    )
    return split_keys(within_fdr(rows, fdr_max), key_kind)


def compare_datasets(spark: SparkSession, datasets: Mapping[str, str], kind: str, fdr_max: float) -> DataFrame:
    """``(dataset, key)`` of several final tables, ready for ``operators.datasets``."""
    rows = None
    for name, path in datasets.items():
        table = read_final_table(spark, path, fdr_max, kind).select(F.lit(name).alias("dataset"), "key")
        rows = table if rows is None else rows.unionByName(table)
    return rows


def read_groups(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(groups, subset)``: (comparison_id, sample) and (comparison_id, protein_acc, position or null)."""
    rows = spark.read.schema("comparison_id string, proteins string, samples string").csv(path, sep="\t", comment="#")
    groups = rows.select("comparison_id", F.explode(F.split("samples", r"\s*,\s*")).alias("sample"))
    places = rows.select("comparison_id", F.explode(F.split("proteins", r"\s*,\s*")).alias("_p"))
    subset = places.select(
        "comparison_id", F.split("_p", "#")[0].alias("protein_acc"),
        F.try_element_at(F.split("_p", "#"), F.lit(2)).try_cast("int").alias("position"),
    )
    return groups.distinct(), subset.distinct()


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    schema = "gene string, transcript string, cell_line string, mutation string, type string, type2 string"
    return spark.read.schema(schema).csv(path, sep="\t")


def read_cell_line_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).toDF("cell_line", "code")


def unknown_cell_lines(mutations: DataFrame, codes: DataFrame) -> DataFrame:
    """Cell lines of the mutation list without a code; an error for the caller."""
    return mutations.select("cell_line").distinct().join(codes, "cell_line", "left_anti")


def groups_from_mutations(mutations: DataFrame, codes: DataFrame, gene_map: DataFrame) -> DataFrame:
    """``(gene, accession, samples)``: samples of each mutated gene, named by their codes.

    ``gene_map`` is (gene, protein_acc, reviewed). The one reviewed accession is taken when there is
    exactly one; else all accessions; ``-`` without any.
    """
    samples = mutations.join(codes, "cell_line").groupBy("gene").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("code"))).alias("samples")
    )
    reviewed = F.count_if(F.col("reviewed"))
    accession = gene_map.groupBy("gene").agg(
        F.when(reviewed == 1, F.max(F.when(F.col("reviewed"), F.col("protein_acc"))))
        .otherwise(F.concat_ws(",", F.array_sort(F.collect_set("protein_acc"))))
        .alias("accession")
    )
    return samples.join(accession, "gene", "left").withColumn("accession", F.coalesce("accession", F.lit("-")))


def run_batch(runs: Mapping[str, DataFrame]) -> DataFrame:
    """The inputs of many runs as one table with ``run_id``; pass ``by=("run_id",)`` to every operator."""
    rows = None
    for run_id, table in runs.items():
        table = table.withColumn("run_id", F.lit(run_id))
        rows = table if rows is None else rows.unionByName(table)
    return rows
