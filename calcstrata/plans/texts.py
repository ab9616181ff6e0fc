"""Fixture texts: (old, new) versions by file name, and directories for cross-file rules."""

_LOG = """LAMMPS (2 Aug 2023)
  {atoms} atoms
Step Temp TotEng PotEng KinEng Press
0 1.44 -1002.8 -1005.0 2.16 0.45
{half} 1.1 -1003.5 -1005.2 1.7 0.40
{last} 1.0 {etot} {pe} {ke} 0.3368
Loop time of 14.3 on 1 procs for {last} steps with {atoms} atoms

Total wall time: {wall}
"""
_DATA = """LJ fluid

{n} atoms
1 atom types

0.0 {b} xlo xhi
0.0 {b} ylo yhi
0.0 {b} zlo zhi

Masses

1 1.0

Atoms

1 1 0.0 0.0 0.0
2 1 1.0 0.0 0.0
"""
_SCRIPT = """# fluid
units lj
atom_style atomic
boundary p p p
pair_style lj/cut 2.5
pair_coeff * * 1.0 1.0 2.5   # first
read_data data.lj
variable T equal 1.0
mass 1 1.0
fix 1 all nvt temp 1.0 1.0 {damp}
thermo {thermo}
timestep {dt}
run {run}
"""
_OUTCAR = """ E-fermi :   {fermi}     XC(G=0): -10.6
  free  energy   TOTEN  =       {e} eV
 Total CPU time used (sec):       42.358
 Elapsed time (sec):       {el}
 Maximum memory used (kb):      125408.
"""
_INPUT = """# water
! {theory} def2-TZVP {more}
%pal nprocs {n} end
%maxcore 4000
%geom
  MaxIter {it}
end
* xyz 0 1
O 0.0 0.0 0.0
H 0.0 0.0 0.96
H 0.93 0.0 -0.24
*
"""
_OUTPUT = """Program Version 5.0.3 - RELEASE
Total Charge           Charge          ....    0
Multiplicity           Mult            ....    1
SCF CONVERGED AFTER   {c} CYCLES
FINAL SINGLE POINT ENERGY      -76.40
THE OPTIMIZATION HAS CONVERGED
FINAL SINGLE POINT ENERGY      {e}
{end}
TOTAL RUN TIME: 0 days 0 hours 2 minutes 14 seconds 321 msec
"""

PAIRS = {
    "run/INCAR": ("ENCUT = 520\nPREC = Accurate\nISMEAR = 0\nSIGMA = 0.05\n", "ENCUT = 600\nPREC = Accurate\nISMEAR = 1\nSIGMA = 0.1\nLWAVE = .FALSE.\n"),
    "cosmetic/INCAR": ("ENCUT = 520\nPREC = Accurate\n", "# This is a comment\nencut  =  520.0\nPREC = Accurate # same\n"),
    "run/KPOINTS": ("Automatic mesh\n0\nGamma\n4 4 4\n", "Other comment\n0\nMonkhorst-Pack\n8 8 8\n0.5 0.5 0.5\n"),
    "retyped/KPOINTS": ("Automatic mesh\n0\nGamma\n4 4 4\n", "bands\n40\nLine-mode\nReciprocal\n0 0 0 ! Gamma\n0.5 0 0 ! X\n\n0.5 0 0 ! X\n0.5 0.5 0\n"),
    "short/KPOINTS": ("Automatic mesh\n0\nGamma\n4 4 4\n", "Too short\n0\n"),
    "run/OUTCAR": (_OUTCAR.format(fermi=5.8921, e=-10.82654316, el=45.123), _OUTCAR.format(fermi=5.8921, e=-10.92654316, el=47.5)),
    "run/in.melt": (_SCRIPT.format(damp=0.1, thermo=100, dt=0.005, run=50000), _SCRIPT.format(damp=0.5, thermo=500, dt=0.002, run="&\n 200000")),
    "run/data.lj": (_DATA.format(n=500, b=20.0), _DATA.format(n=512, b=21.0)),
    "run/log.lammps": (
        _LOG.format(atoms=500, half=25000, last=50000, etot=-1004.285, pe=-1005.4936, ke=1.813, wall="0:00:14"),
        _LOG.format(atoms=512, half=100000, last=200000, etot=-1007.8214, pe=-1009.0344, ke=1.213, wall="0:00:57"),
    ),
    "run/water.inp": (_INPUT.format(theory="B3LYP", more="Opt TightSCF", n=4, it=50), _INPUT.format(theory="PBE0", more="Opt VeryTightSCF", n=8, it=100)),
    "run/water.out": (_OUTPUT.format(c=9, e=-76.4345661023, end="ORCA TERMINATED NORMALLY"), _OUTPUT.format(c=12, e=-76.4401, end="ERROR TERMINATION")),
}

_POSCAR = "cell\n1.0\n3 0 0\n0 3 0\n0 0 3\n{el}\n{n}\nDirect\n0 0 0\n0.5 0.5 0.5\n0.5 0 0\n0 0.5 0\n"
_POTCAR = "".join("  TITEL  = PAW_PBE {e} 05Jan2001\n".replace("{e}", "{%d}" % i) for i in range(3))

DIRECTORIES = [
    ("ok/POSCAR", _POSCAR.format(el="Li Co O", n="1 1 2")),
    ("ok/POTCAR", _POTCAR.format("Li_sv", "Co", "O")),
    ("ok/INCAR", "MAGMOM = 1*0.6 1*0.6 2*0.0\nISPIN = 2\nLDAUU = 0 3 0\n"),
    ("order/POSCAR", _POSCAR.format(el="Li Co O", n="1 1 2")),
    ("order/POTCAR", _POTCAR.format("Co", "Li", "Si")),
    ("order/INCAR", "MAGMOM = 2*0.6\nLDAUU = 5 5\nISPIN = 2\n"),
    ("alone/POSCAR", _POSCAR.format(el="Li Co O", n="1 1 2")),
    ("alone/INCAR", "ISPIN = 2\nNSW = 0\nISIF = 3\n"),
    ("broken/POSCAR", "cell\n0\n3 0 0\n0 3 0\n0 0\n1 2\nx\n"),
    ("broken/INCAR", "ENCUT = 520\n"),
    ("broken/KPOINTS", "Test\n0\nGamma\nnot a number\n"),
]
