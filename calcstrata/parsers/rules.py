"""What is diffed, in which order, how serious it is, and how close numbers may be: fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diffed paths in order; types not listed here order by path.
ORDER = {
    "KPOINTS": ("type", "gamma_centered", "grid", "shift", "num_kpoints", "cartesian", "num_points", "num_segments"),
    "OUTCAR": ("final_energy", "efermi", "is_stopped", "total_magnetization", "run_stats"),
    "LAMMPS_INPUT": (
        "units", "pair_style", "kspace_style", "timestep", "run", "minimize_etol", "minimize_ftol", "minimize_maxiter", "minimize_maxeval", "boundary", "atom_style", "dimension",
        "fix_nvt", "fix_npt", "fix_nve", "thermo", "pair_coeff", "read_data", "variable_names", "mass",
    ),
    "LAMMPS_DATA": (
        "num_atoms", "num_atom_types", "lx", "ly", "lz", "volume", "has_bonds", "num_bonds", "num_bond_types", "num_angles", "num_angle_types", "num_dihedrals", "num_dihedral_types",
        "num_impropers", "num_improper_types", "title", "masses",
    ),
    "LAMMPS_LOG": ("final_etotal", "final_pe", "final_ke", "final_temp", "final_press", "run_steps", "num_atoms", "completed", "wall_time"),
    "ORCA_INPUT": ("charge", "multiplicity", "coord_format", "maxcore", "nprocs", "coordinates"),
    "ORCA_OUTPUT": ("final_energy", "termination_status", "optimization_converged", "charge", "multiplicity", "scf_cycles", "scf_converged", "orca_version", "wall_time"),
}

CRITICAL = {
    "INCAR": ("ENCUT", "PREC", "ALGO", "LREAL", "ISMEAR", "SIGMA", "EDIFF", "EDIFFG", "NSW", "IBRION", "POTIM", "ISIF", "NELM", "NELMIN"),
    "KPOINTS": ("type", "grid", "num_kpoints"),
    "OUTCAR": ("final_energy", "efermi", "is_stopped"),
    "LAMMPS_INPUT": ("units", "pair_style", "kspace_style", "timestep", "run", "minimize_etol", "minimize_ftol", "minimize_maxiter", "minimize_maxeval"),
    "LAMMPS_DATA": ("num_atoms", "num_atom_types", "lx", "ly", "lz", "volume"),
    "LAMMPS_LOG": ("final_etotal", "final_pe", "completed"),
    "ORCA_INPUT": ("charge", "multiplicity", "coord_format", "coordinates"),
    "ORCA_OUTPUT": ("final_energy", "termination_status", "optimization_converged", "charge", "multiplicity"),
}
MAJOR = {
    "INCAR": ("LWAVE", "LCHARG", "LORBIT", "LVTOT", "LVHAR", "ISPIN", "MAGMOM", "NCORE", "KPAR", "LDAU", "LDAUTYPE", "LDAUL", "LDAUU", "LDAUJ", "IVDW", "LUSE_VDW", "AGGAC"),
    "KPOINTS": ("gamma_centered", "shift", "cartesian", "num_segments"),
    "OUTCAR": ("total_magnetization",),
    "LAMMPS_INPUT": ("boundary", "atom_style", "dimension", "fix_nvt", "fix_npt", "fix_nve"),
    "LAMMPS_DATA": ("has_bonds", "num_bonds", "num_bond_types", "num_angles", "num_angle_types", "num_dihedrals", "num_dihedral_types", "num_impropers", "num_improper_types", "masses"),
    "LAMMPS_LOG": ("final_temp", "final_press", "run_steps", "num_atoms"),
    "ORCA_INPUT": ("maxcore", "nprocs"),
    "ORCA_OUTPUT": ("dipole_moment", "scf_cycles", "scf_converged"),
}
MAJOR_BLOCKS = {"pal": ("nprocs",), "scf": ("convergence", "maxiter", "thresh", "tcut"), "cpcm": ("epsilon", "refrac"), "tddft": ("nroots", "iroot"), "mdci": ("tcutpno", "tcutpairs", "locmet")}

#: Keywords that change the model or what is computed (upper case, so TPSSH counts).
CRITICAL_KEYWORDS = (
    "HF", "RHF", "UHF", "ROHF", "CASSCF", "MP2", "RI-MP2", "OO-MP2", "SCS-MP2", "DLPNO-MP2", "DLPNO-MP2-F12", "CCSD", "CCSD(T)", "CCSD-F12", "CCSD(T)-F12", "DLPNO-CCSD", "DLPNO-CCSD(T)", "DLPNO-CCSD(T1)",
    "BLYP", "BP86", "PBE", "TPSS", "B97", "B3LYP", "PBE0", "TPSSH", "BHLYP", "X3LYP", "B1LYP", "B97-3C", "PBEH-3C", "R2SCAN-3C", "M06", "M06-2X", "M06-L", "M06-HF",
    "WB97X", "WB97X-D", "WB97X-D3", "WB97M-V", "WB97X-V", "CAM-B3LYP", "LC-BLYP", "LC-PBE", "LONG-RANGE-CORRECTED", "B2PLYP", "B2GP-PLYP", "DSDPBEP86", "PWPB95", "SCAN", "R2SCAN",
    "SP", "OPT", "COPT", "ZOPT", "GDIIS-OPT", "FREQ", "NUMFREQ", "NFREQ", "NMR", "SOCOUPLING", "MD", "IRC", "TDDFT", "DKH", "DKH2", "DKH3", "ZORA", "IORA", "X2C", "DKH-X2C",
)
#: Keywords that change accuracy or cost.
MAJOR_KEYWORDS = (
    "SLOPPYSCF", "LOOSESCF", "NORMALSCF", "STRONGSCF", "TIGHTSCF", "VERYTIGHTSCF", "EXTREMESCF", "DEFGRID1", "DEFGRID2", "DEFGRID3", "GRID1", "GRID2", "GRID3", "GRID4", "GRID5",
    "FINALGRID1", "FINALGRID2", "FINALGRID3", "FINALGRID4", "FINALGRID5", "FINALGRID6", "GRIDX5", "RI", "RI-J", "RIJONX", "RIJK", "RIJCOSX", "NORIJCOSX", "NORI",
    "D2", "D3", "D3BJ", "D3ZERO", "D4", "NODAMP", "NL", "CPCM", "SMD", "FROZENCORE", "NOFROZENCORE", "SMALLCORE", "NOECP", "LARGEMEM", "NORMALMEM", "SMALLMEM", "AUTOAUX", "NOAUTOAUX",
)
BASIS_KEYWORD = r"^(DEF2-|AUG-CC-P|CC-P|PC-\d|MINIX|STO-\d|6-3\d|MA-DEF2-|SARC-)"
METHOD_KEYWORD = r"^(B\d|PBE\d?|M\d{2}[-\d]?|WB97|LC-|CAM-|RANGE-)"

#: Paths compared as sets or maps, whose changes always count as modified.
ALWAYS_MODIFIED = {"LAMMPS_INPUT": ("read_data", "variable_names", "mass"), "LAMMPS_DATA": ("masses",), "ORCA_INPUT": ("coordinates",)}
SETS = ("read_data", "variable_names")

#: Numbers closer than this are equal, by type and path, for types that are not built in.
TOLERANCES: dict[str, dict[str, float]] = {}


def significance(file_type: Column, path: Column) -> Column:
    def keyword(word: Column) -> Column:
        high = word.isin(*CRITICAL_KEYWORDS)
        return F.when(high, "critical").when(word.isin(*MAJOR_KEYWORDS), "major").when(word.rlike(BASIS_KEYWORD) | word.rlike(METHOD_KEYWORD), "critical").otherwise("minor")

    blocks = [f"block.{b}.{k}" for b, ks in MAJOR_BLOCKS.items() for k in ks]
    out = F.when(path.startswith("keyword."), keyword(path.substr(F.lit(9), F.length(path)))).when(path.isin(*blocks), "major")
    for kind in CRITICAL:
        own = file_type == kind
        out = out.when(own & path.isin(*CRITICAL[kind]), "critical").when(own & path.isin(*MAJOR.get(kind, ())), "major")
    return out.otherwise("minor")


def order(file_type: Column, path: Column) -> Column:
    """Place of a path in its type's list; 0 if it is not diffed there, null if the type has no list."""
    out = F.lit(None).cast("int")
    for kind, paths in ORDER.items():
        out = F.when(file_type == kind, F.array_position(F.array(*map(F.lit, paths)), path).cast("int")).otherwise(out)
    return out


def tolerance(file_type: Column, path: Column) -> Column:
    energy = path == "final_energy"
    out = (
        F.when((file_type == "OUTCAR") & energy, 1e-8).when((file_type == "ORCA_OUTPUT") & energy, 1e-10)
        .when(file_type == "LAMMPS_INPUT", 1e-15).when(file_type == "LAMMPS_DATA", 1e-8).when(file_type == "LAMMPS_LOG", 1e-10)
    )
    for kind, own in TOLERANCES.items():
        for name, close in own.items():
            out = out.when((file_type == kind) & (path == name), close)
    return out
