"""The index description language: ``PCA16,IVF64,PQ8,RFlat`` and the like, as a specification."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Pattern of a part -> its kind and what the numbers mean.
TRANSFORMS = [(r"PCA(W?)(R?)(\d+)", "pca"), (r"L2norm", "l2norm"), (r"RR(\d+)?", "rotation"), (r"ITQ(\d+)?", "itq"), (r"OPQ(\d+)(?:_(\d+))?", "opq"), (r"Pad(\d+)", "pad")]
COARSE = [(r"IVF(\d+)([kM]?)(?:_(HNSW|NSG)(\d+))?", "ivf"), (r"IMI2x(\d+)", "imi"), (r"Residual(\d+)x(\d+)", "residual")]
CODECS = [
    (r"Flat", "flat"), (r"FlatDedup", "flat_dedup"), (r"SQ(8|6|4|fp16|bf16|8_direct|8_direct_signed)", "sq"), (r"PQ(\d+)(?:x(\d+))?(np|fs|fsr)?(?:_\d+)?", "pq"), (r"PQ(\d+)\+(\d+)", "pq_refined"),
    (r"(RQ|RCQ|LSQ|LSCQ)(\d+)x(\d+)(?:fs)?.*", "additive"), (r"(PRQ|PLSQ)(\d+)x(\d+)x(\d+).*", "product_additive"), (r"LSH(\d+)?(r?)(t?)", "lsh"), (r"ZnLattice(\d+)x(\d+)_(\d+)", "lattice"), (r"RaBitQ", "rabit"),
    (r"(?:ITQ|PCA|PCAR)(\d+)?,SH([-0-9.e]+)?[gcm]?", "spectral"), (r"HNSW(\d+)?", "graph"), (r"NSG(\d+)?", "graph"),
]
BINARY = [(r"BFlat", "flat"), (r"BIVF(\d+)(?:_HNSW(\d+))?", "ivf"), (r"BHNSW(\d+)?", "graph"), (r"BHash(\d+)(?:x(\d+))?", "hash")]


@dataclass
class IndexSpec:
    transforms: list[tuple[str, tuple]] = field(default_factory=list)
    coarse: tuple[str, tuple] | None = None
    codec: tuple[str, tuple] = ("flat", ())
    refine: IndexSpec | None = None
    id_map: bool = False
    binary: bool = False

    def __str__(self) -> str:
        return reverse(self)


def _numbers(groups: tuple) -> tuple:
    return tuple(int(g) if g is not None and re.fullmatch(r"\d+", g) else g for g in groups)


def _match(table: list, part: str):
    for pattern, kind in table:
        if m := re.fullmatch(pattern, part):
            return kind, _numbers(m.groups())
    return None


def _split(text: str) -> list[str]:
    """Parts at commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def parse(text: str) -> IndexSpec:
    """The specification of a description; an unknown part is an error."""
    spec, parts = IndexSpec(), _split(text.replace(" ", ""))
    if parts[0] in ("IDMap", "IDMap2"):
        spec.id_map = True
        parts = parts[1:]
    elif parts[-1] in ("IDMap", "IDMap2"):
        spec.id_map = True
        parts = parts[:-1]
    if parts and (m := re.fullmatch(r"Refine\((.*)\)", parts[-1])):
        spec.refine = parse(m[1])
        parts = parts[:-1]
    elif parts and parts[-1] == "RFlat":
        spec.refine = IndexSpec()
        parts = parts[:-1]
    if parts and (found := _match(BINARY, parts[0])):
        if len(parts) > 1:
            raise ValueError(f"unknown part {parts[1]!r}")
        spec.binary, spec.codec = True, found
        return spec
    while parts and (found := _match(TRANSFORMS, parts[0])) and not (len(parts) > 1 and parts[1].startswith("SH")):
        spec.transforms.append(found)
        parts = parts[1:]
    if parts and (found := _match(COARSE, parts[0])):
        kind, args = found
        if kind == "ivf":
            args = (args[0] * {"": 1, "k": 1024, "M": 1 << 20}[args[1] or ""], args[2], args[3])
        spec.coarse = kind, args
        parts = parts[1:]
    if parts and parts[0].startswith(("HNSW", "NSG")) and len(parts) > 1:
        parts = [parts[0]] if parts[1] == "Flat" else [parts[1]]
    if len(parts) > 1 and parts[1].startswith("SH"):
        parts = [",".join(parts[:2]), *parts[2:]]
    if parts:
        if not (found := _match(CODECS, parts[0])) or len(parts) > 1:
            raise ValueError(f"unknown part {(parts[1] if found else parts[0])!r}")
        spec.codec = found
    return spec


def reverse(spec: IndexSpec) -> str:
    """A description that parses to the same specification."""
    names = {"l2norm": "L2norm", "rotation": "RR", "itq": "ITQ", "pad": "Pad"}
    out = ["IDMap"] if spec.id_map else []
    for kind, a in spec.transforms:
        out.append("PCA" + (a[0] or "") + (a[1] or "") + str(a[2]) if kind == "pca" else f"OPQ{a[0]}" + (f"_{a[1]}" if a[1] else "") if kind == "opq" else names[kind] + "".join(str(x) for x in a if x is not None))
    if spec.coarse:
        kind, a = spec.coarse
        out.append(f"IVF{a[0]}" + (f"_{a[1]}{a[2]}" if a[1] else "") if kind == "ivf" else f"IMI2x{a[0]}" if kind == "imi" else f"Residual{a[0]}x{a[1]}")
    kind, a = spec.codec
    text = {
        "flat": lambda: "BFlat" if spec.binary else "Flat", "flat_dedup": lambda: "FlatDedup", "sq": lambda: f"SQ{a[0]}", "pq": lambda: f"PQ{a[0]}" + (f"x{a[1]}" if a[1] else "") + (a[2] or ""), "pq_refined": lambda: f"PQ{a[0]}+{a[1]}",
        "additive": lambda: f"{a[0]}{a[1]}x{a[2]}", "product_additive": lambda: f"{a[0]}{a[1]}x{a[2]}x{a[3]}", "lsh": lambda: "LSH" + str(a[0] or "") + (a[1] or "") + (a[2] or ""), "lattice": lambda: f"ZnLattice{a[0]}x{a[1]}_{a[2]}",
        "rabit": lambda: "RaBitQ", "spectral": lambda: f"ITQ{a[0] or ''},SH{a[1] or ''}", "graph": lambda: ("BHNSW" if spec.binary else "HNSW") + str(a[0] or ""), "ivf": lambda: f"BIVF{a[0]}", "hash": lambda: f"BHash{a[0]}" + (f"x{a[1]}" if a[1] else ""),
    }
    out.append(text[kind]())
    if spec.refine is not None:
        out.append("RFlat" if spec.refine == IndexSpec() else f"Refine({reverse(spec.refine)})")
    return ",".join(out)


def code_size(spec: IndexSpec, d: int) -> int:
    """Bytes of one stored vector."""
    kind, a = spec.codec
    sizes = {
        "flat": lambda: 4 * d, "flat_dedup": lambda: 4 * d, "graph": lambda: 4 * d + 8 * (a[0] or 32), "sq": lambda: {8: d, "8": d, 6: -(-d * 6 // 8), 4: -(-d // 2)}.get(a[0], 2 * d if a[0] in ("fp16", "bf16") else d),
        "pq": lambda: -(-a[0] * (a[1] or 8) // 8), "pq_refined": lambda: a[0] + a[1], "additive": lambda: -(-a[1] * a[2] // 8), "product_additive": lambda: -(-a[1] * a[2] * a[3] // 8), "lsh": lambda: -(-(a[0] or d) // 8), "rabit": lambda: -(-d // 8) + 8,
        "spectral": lambda: -(-(a[0] or d) // 8), "lattice": lambda: -(-a[0] * a[2] // 8),
    }
    return sizes[kind]()
