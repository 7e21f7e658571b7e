"""Readers of structure files: mmCIF and PDB text to atoms, and mmCIF metadata. Files are read by Spark, one row a file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

ATOMS = "source_file string, chain_id string, chain_order int, res_index int, resseq int, icode string, resname string, atom_index int, atom_name string, element string, x double, y double, z double, occupancy double, b_factor double"
#: Where a resolution may stand, in the order of preference.
RESOLUTION_TAGS = (
    "_refine.ls_d_res_high",
    "_reflns.d_resolution_high",
    "_refine_hist.d_res_high",
    "_diffrn_reflns.d_resolution_high",
    "_diffrn_reflns_shell.d_res_high",
    "_reflns_shell.d_res_high",
    "_database_pdb_remark.angstroms",
    "_em_3d_reconstruction.resolution",
)
_TOKEN = re.compile(r"""^;(.*?)\n;|'((?:[^'\n]|'(?=\S))*)'(?=\s|\Z)|"((?:[^"\n]|"(?=\S))*)"(?=\s|\Z)|(?:^|(?<=\s))\#[^\n]*|(\S+)""", re.M | re.S)


def cif_values(text: str, wanted: tuple[str, ...]) -> dict[str, list[str]]:
    """The values of the tags that begin with one of ``wanted`` (lower case), one for a plain item and many for a loop.

    A tag's later data blocks are ignored. Text between semicolons and quotes loses them.
    """
    tokens = ((m[4], m[1] if m[1] is not None else m[2] if m[2] is not None else m[3]) for m in _TOKEN.finditer(text) if m[0][:1] != "#" or m[4])
    out: dict[str, list[str]] = {}
    tags: list[str] = []
    mode, item, at, block = "", "", 0, 0
    for bare, quoted in tokens:
        word = bare.lower() if bare is not None else ""
        if word.startswith("data_"):
            block += 1
            if block > 1:
                break
            mode = ""
        elif word == "loop_":
            mode, tags, at = "loop", [], 0
        elif word.startswith("_"):
            if mode == "loop":
                tags.append(word)
                if word.startswith(wanted):
                    out.setdefault(word, [])
            else:
                mode, item = "item", word
            if mode == "rows":
                mode, item = "item", word
        elif mode in ("loop", "rows") and tags:
            if mode == "loop":
                mode = "rows"
            tag = tags[at % len(tags)]
            at += 1
            if tag in out:
                out[tag].append(bare if bare is not None else quoted)
        elif mode == "item":
            if item.startswith(wanted):
                out.setdefault(item, []).append(bare if bare is not None else quoted)
            mode = ""
    return out


def cif_atoms(name: str, text: str) -> list[tuple]:
    """The heavy atoms of standard residues in the first model, chains by author name in order of appearance.

    All alternates stay. A residue is a run of atoms with one number, insertion code and name; ``res_index`` counts those of its
    chain from 0. Columns are found by name, whatever their order.
    """
    v = cif_values(text, ("_atom_site.",))
    get = lambda *tags: next((v[f"_atom_site.{t}"] for t in tags if f"_atom_site.{t}" in v), None)
    x = get("cartn_x")
    if not x:
        return []
    n = len(x)
    column = lambda *tags, other="": get(*tags) or [other] * n
    number = lambda t, other: float(t) if t not in ("", ".", "?") else other
    chains, names, comps = column("auth_asym_id", "label_asym_id"), column("auth_atom_id", "label_atom_id"), column("auth_comp_id", "label_comp_id")
    seqs, icodes, elements, models = column("auth_seq_id", "label_seq_id", other="1"), column("pdbx_pdb_ins_code", other="?"), column("type_symbol"), column("pdbx_pdb_model_num", other="1")
    y, z, occ, b = get("cartn_y"), get("cartn_z"), column("occupancy", other="1"), column("b_iso_or_equiv", other="0")
    out, order, last, count = [], {}, {}, {}
    for i in range(n):
        if models[i] != models[0] or elements[i].upper() == "H" or comps[i].upper() not in S.ONE_LETTER:
            continue
        chain, icode = chains[i], "" if icodes[i] in ("?", ".") else icodes[i]
        order.setdefault(chain, len(order))
        key = (seqs[i], icode, comps[i])
        if last.get(chain) != key:
            last[chain] = key
            count[chain] = count.get(chain, -1) + 1
        seq = int(seqs[i]) if seqs[i] not in (".", "?") else 1
        out.append((name, chain, order[chain], count[chain], seq, icode, comps[i], i, names[i], elements[i].upper(), float(x[i]), float(y[i]), float(z[i]), number(occ[i], 1.0), number(b[i], 0.0)))
    return out


def pdb_atoms(name: str, text: str) -> list[tuple]:
    """The same from fixed-width records, up to the end of the first model."""
    out, order, last, count = [], {}, {}, {}
    for i, line in enumerate(text.split("\n")):
        if line.startswith("ENDMDL"):
            break
        if not line.startswith(("ATOM", "HETATM")):
            continue
        atom, comp, chain = line[12:16].strip(), line[17:20].strip(), line[21:22].strip()
        element = (line[76:78].strip() or atom.lstrip("0123456789")[:1]).upper()
        if element == "H" or comp.upper() not in S.ONE_LETTER:
            continue
        order.setdefault(chain, len(order))
        key = (line[22:26], line[26:27], comp)
        if last.get(chain) != key:
            last[chain] = key
            count[chain] = count.get(chain, -1) + 1
        number = lambda s, other: float(s) if s.strip() else other
        out.append((name, chain, order[chain], count[chain], int(line[22:26]), line[26:27].strip(), comp, i, atom, element, float(line[30:38]), float(line[38:46]), float(line[46:54]), number(line[54:60], 1.0), number(line[60:66], 0.0)))
    return out


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``(source_file, text)``: the folder's files that match, one a row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), F.col("content").cast("string").alias("text"))


#: What a worker adds to the rows of a file: whether it was read, and if not, why.
OUTCOME = "ok boolean, error struct<type:string,message:string,traceback:string>"


def parsed(texts: DataFrame, kind: str = "cif") -> DataFrame:
    """Atoms of ``texts`` (source_file, text) with ``ok`` and ``error``; a file that cannot be parsed has one row, with its error.

    Coordinates have the precision of 32-bit floats, widened. Write the frame once, then take ``good`` and ``failed`` rows from it.
    """
    parse = cif_atoms if kind == "cif" else pdb_atoms
    names = [c.split()[0] for c in ATOMS.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import traceback

        for batch in batches:
            for name, text in zip(batch["source_file"], batch["text"]):
                try:
                    out = pd.DataFrame(parse(name, text or ""), columns=names).assign(ok=True, error=None)
                except Exception as e:  # whatever is wrong with a file is a row of the result, not the end of the run
                    why = {"type": type(e).__name__, "message": str(e), "traceback": traceback.format_exc()}
                    out = pd.DataFrame([(name, *[None] * (len(names) - 1), False, why)], columns=[*names, "ok", "error"])
                yield out

    out = texts.select("source_file", "text").mapInPandas(rows, f"{ATOMS}, {OUTCOME}")
    return out.withColumns({c: F.col(c).cast("float").cast("double") for c in "xyz"})


def good(rows: DataFrame) -> DataFrame:
    """The rows of what was read, without the outcome's columns."""
    return rows.filter("ok").drop("ok", "error")


def failed(rows: DataFrame) -> DataFrame:
    """``(source_file, type, message, traceback)`` of what was not read: the dead letters."""
    return rows.filter("not ok").select("source_file", "error.*")


def atoms(texts: DataFrame, kind: str = "cif") -> DataFrame:
    """The atoms of the files that can be parsed; ``failed(parsed(texts))`` tells which cannot, and why."""
    return good(parsed(texts, kind))


def metadata(texts: DataFrame) -> DataFrame:
    """``(source_file, pdb_id, method, resolution, n_atoms, metadata_error)`` of mmCIF texts.

    Several methods are joined by ``; ``; the resolution is the first readable of the tags, in order; null if none is.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch["source_file"], batch["text"]):
                v = cif_values(text or "", ("_exptl.method", "_entry.id", "_atom_site.cartn_x", *RESOLUTION_TAGS))
                tags = [next(iter(v.get(t, [])), None) for t in RESOLUTION_TAGS]
                out.append((name, next(iter(v.get("_entry.id", [])), None), "; ".join(x.strip() for x in v.get("_exptl.method", [])) or None, tags, len(v.get("_atom_site.cartn_x", []))))
            yield pd.DataFrame(out, columns=["source_file", "entry", "method", "tags", "n_atoms"])

    got = texts.select("source_file", "text").mapInPandas(rows, "source_file string, entry string, method string, tags array<string>, n_atoms long")
    resolution = F.coalesce(*(S.lenient_double(F.element_at("tags", i + 1)) for i in range(len(RESOLUTION_TAGS))))
    stem = F.lower(F.regexp_replace("source_file", r"\.[^.]*$", ""))
    return got.select("source_file", F.lower(F.coalesce("entry", stem)).alias("pdb_id"), "method", resolution.alias("resolution"), "n_atoms", (F.col("n_atoms") == 0).alias("metadata_error"))
