"""Fixed values of the domain: item classes, units, shorthand and the standards graph.

Everything here is data. A class, a unit or a designation is added by a line,
not by code. Fields are parted by |, lists by ;.
"""

from __future__ import annotations

from dataclasses import dataclass


def _rows(text: str) -> list[list[str]]:
    return [[f.strip() for f in line.split("|")] for line in text.strip().splitlines() if line.strip()]


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.split(";") if x.strip()]


# Class | item name | NSC | UNSPSC | HSN | ECLASS | keywords
CLASS_ROWS = """
FASTENER_BOLT | BOLT, HEXAGON HEAD | 5306 | 31161501 | 73181500 | 23-11-01-01 | BOLT; HEX BOLT; HEXAGON BOLT; HEXAGONAL BOLT; SCREW HEX; HEX HD BOLT; SETSCREW; SET SCREW; STUD BOLT; STUD
FASTENER_NUT | NUT, HEXAGON | 5310 | 31161600 | 73181600 | 23-11-03-01 | NUT; HEX NUT; HEXAGON NUT; LOCK NUT; NYLOC
PIPE | PIPE, SEAMLESS | 4710 | 40174000 | 73041900 | 36-01-01-01 | PIPE; SEAMLESS PIPE; ERW PIPE; TUBE; TUBING
PIPE_FITTING | FITTING, PIPE | 4730 | 40142000 | 73079900 | 36-02-01-01 | ELBOW; TEE; REDUCER; FLANGE; COUPLING; UNION; NIPPLE; CAP; BEND; FITTING
VALVE | VALVE | 4820 | 40141600 | 84818030 | 37-01-01-01 | VALVE; GATE VALVE; GLOBE VALVE; BALL VALVE; CHECK VALVE; BUTTERFLY VALVE; NEEDLE VALVE; PLUG VALVE; SAFETY VALVE
BEARING | BEARING, BALL, ANNULAR | 3110 | 31171500 | 84821011 | 23-05-01-01 | BEARING; BALL BEARING; ROLLER BEARING; BRG; DEEP GROOVE
CABLE | CABLE, POWER, INSULATED | 6145 | 26121600 | 85446090 | 27-06-01-01 | CABLE; WIRE; CONDUCTOR; FLEXIBLE CABLE; POWER CABLE; CONTROL CABLE
GASKET | GASKET | 5330 | 31401500 | 84841000 | 23-12-01-01 | GASKET; SPIRAL WOUND; RING JOINT; SEAL RING; JOINTING SHEET
GENERIC | ITEM | 9999 | 00000000 | 00000000 | 00-00-00-00 | 
"""

# Class | attribute | label | unit | flags | ordinal scale
# M mandatory, B blocking, N numeric, K compared through the graph, S standard, Q service qualifier
ATTRIBUTE_ROWS = """
FASTENER_BOLT | thread | THREAD |  | MB | 
FASTENER_BOLT | length_mm | LENGTH | MM | MBN | 
FASTENER_BOLT | material | MATERIAL |  | MBK | 
FASTENER_BOLT | grade | GRADE |  | K | property_class
FASTENER_BOLT | ss_class | CLASS |  | K | ss_fastener_class
FASTENER_BOLT | standard | STD |  | S | 
FASTENER_BOLT | head | HEAD |  | B | 
FASTENER_BOLT | thread_length | THREAD LENGTH |  |  | 
FASTENER_BOLT | finish | FINISH |  |  | 
FASTENER_BOLT | service | SERVICE |  | BQ | 
FASTENER_NUT | thread | THREAD |  | MB | 
FASTENER_NUT | material | MATERIAL |  | MBK | 
FASTENER_NUT | grade | GRADE |  | K | property_class
FASTENER_NUT | ss_class | CLASS |  | K | ss_fastener_class
FASTENER_NUT | standard | STD |  | S | 
FASTENER_NUT | style | STYLE |  | B | 
FASTENER_NUT | finish | FINISH |  |  | 
FASTENER_NUT | service | SERVICE |  | BQ | 
PIPE | nominal_size | SIZE | NB | MB | 
PIPE | schedule | SCHEDULE |  | M | pipe_schedule
PIPE | material | MATERIAL |  | MBK | 
PIPE | construction | CONSTRUCTION |  | B | 
PIPE | standard | STD |  | S | 
PIPE | end_connection | ENDS |  | B | 
PIPE | finish | FINISH |  |  | 
PIPE | service | SERVICE |  | BQ | 
PIPE_FITTING | fitting_type | TYPE |  | MB | 
PIPE_FITTING | nominal_size | SIZE | NB | MB | 
PIPE_FITTING | pressure_class | CLASS |  |  | pressure_class
PIPE_FITTING | schedule | SCHEDULE |  |  | pipe_schedule
PIPE_FITTING | material | MATERIAL |  | MBK | 
PIPE_FITTING | end_connection | ENDS |  | B | 
PIPE_FITTING | angle | ANGLE |  | B | 
PIPE_FITTING | standard | STD |  | S | 
PIPE_FITTING | service | SERVICE |  | BQ | 
VALVE | valve_type | TYPE |  | MB | 
VALVE | nominal_size | SIZE | NB | MB | 
VALVE | pressure_class | CLASS |  | M | pressure_class
VALVE | material | BODY MATERIAL |  | MBK | 
VALVE | trim | TRIM |  | K | 
VALVE | end_connection | ENDS |  | MB | 
VALVE | operation | OPERATION |  | B | 
VALVE | standard | STD |  | S | 
VALVE | service | SERVICE |  | BQ | 
BEARING | designation | DESIGNATION |  | MB | 
BEARING | bore_mm | BORE | MM | MBN | 
BEARING | series | SERIES |  | B | 
BEARING | seal | SEAL |  | B | 
BEARING | clearance | CLEARANCE |  | B | 
BEARING | material | MATERIAL |  | K | 
BEARING | standard | STD |  | S | 
CABLE | cores | CORES |  | MBN | 
CABLE | csa_sqmm | CROSS SECTION | SQMM | MBN | 
CABLE | voltage | VOLTAGE GRADE |  | M | cable_voltage
CABLE | insulation | INSULATION |  | MBK | 
CABLE | conductor | CONDUCTOR |  | MBK | 
CABLE | armour | ARMOUR |  | BK | 
CABLE | standard | STD |  | S | 
GASKET | gasket_type | TYPE |  | MB | 
GASKET | nominal_size | SIZE | NB | MB | 
GASKET | pressure_class | CLASS |  | MB | pressure_class
GASKET | material | FILLER MATERIAL |  | MBK | 
GASKET | winding | WINDING |  | K | 
GASKET | standard | STD |  | S | 
GASKET | service | SERVICE |  | BQ | 
GENERIC | noun | NOUN |  | MB | 
GENERIC | material | MATERIAL |  | K | 
GENERIC | standard | STD |  | S | 
GENERIC | service | SERVICE |  | BQ | 
"""

# Marks of items made to order
ENGINEERED = _list("AS PER DRAWING; AS PER DRG; AS PER ATTACHED; CUSTOM BUILT; FABRICATED TO ORDER; MADE TO ORDER; TAILOR MADE; SPECIAL FABRICATION; AS PER SPEC NO; SKID; PACKAGE UNIT; TURNKEY; ENGINEERED TO ORDER; ETO; BESPOKE")

# Dimension | base unit
BASE_ROWS = """
length | MTR
mass | KGM
count | C62
volume | LTR
area | MTK
time | HUR
"""

# Unit | dimension | factor to the base unit | names
UNIT_ROWS = """
MTR | length | 1.0 | M; MTR; MT; MTRS; METER; METRE; METERS; METRES; RM; RMT; R.MTR; RUNNING METER; RUNNING METRE
CMT | length | 0.01 | CM; CMT; CENTIMETER; CENTIMETRE
MMT | length | 0.001 | MM; MMT; MILLIMETER; MILLIMETRE
KMT | length | 1000.0 | KM; KMT; KILOMETER; KILOMETRE
INH | length | 0.0254 | IN; INH; INCH; INCHES; "
FOT | length | 0.3048 | FT; FOT; FEET; FOOT; '
KGM | mass | 1.0 | KG; KGM; KGS; KILO; KILOGRAM; KILOGRAMME
GRM | mass | 0.001 | G; GM; GRM; GRAM; GRAMS
TNE | mass | 1000.0 | T; TON; TONNE; TNE; MT-TON; METRIC TON
QTL | mass | 100.0 | QTL; QUINTAL
C62 | count | 1.0 | NO; NOS; NO.; EA; EACH; PC; PCS; PIECE; PIECES; ST; UNIT; UNITS; C62; N; NUMBER; ITEM
PR | count | 2.0 | PR; PAIR; PAIRS
DZN | count | 12.0 | DZ; DOZ; DZN; DOZEN
GRO | count | 144.0 | GRO; GROSS
CEN | count | 100.0 | CEN; HUNDRED; HND; C
MIL | count | 1000.0 | MIL; THOUSAND; TH
LTR | volume | 1.0 | L; LTR; LIT; LITRE; LITER; LITRES; LITERS
MLT | volume | 0.001 | ML; MLT; MILLILITRE; MILLILITER
MTQ | volume | 1000.0 | M3; CBM; MTQ; CUM; CUBIC METER; CUBIC METRE
MTK | area | 1.0 | M2; SQM; MTK; SQ.M; SQUARE METER; SQUARE METRE
MMK | area | 1e-06 | MM2; SQMM; SQ.MM; MMK; SQ MM; SQUARE MM
HUR | time | 1.0 | HR; HUR; HOUR; HOURS
DAY | time | 24.0 | DAY; DAYS
"""

# Pack | dimension | usual content | its unit | names
PACK_ROWS = """
DRUM | length | 500.0 | MTR | DRUM; DRM; DRUMS; CABLE DRUM
COIL | length | 100.0 | MTR | COIL; COL; COILS
ROLL | length | 50.0 | MTR | ROLL; ROL; ROLLS
BOX | count | 100.0 | C62 | BOX; BOXES; BX; CTN; CARTON
PKT | count | 50.0 | C62 | PKT; PKTS; PACKET; PACK; PK
BAG | mass | 50.0 | KGM | BAG; BAGS; SACK
CAN | volume | 20.0 | LTR | CAN; TIN; CANS
BARREL | volume | 208.2 | LTR | BBL; BARREL; BRL
SET | count | 1.0 | C62 | SET; SETS; KIT; KITS; AU
BUNDLE | count | 10.0 | C62 | BDL; BUNDLE; BUNDLES
"""

# How descriptions state a pack's content (quantity, unit), first match wins
PACK_PATTERNS = [
    r"(?:OF|=|:)\s*(\d+(?:\.\d+)?)\s*(MTR|M|MTRS|METER|METRE|NOS|NO|PCS|PC|EA|KG|KGS|LTR|L)\b",
    r"(\d+(?:\.\d+)?)\s*(MTR|M|MTRS|METER|METRE|NOS|NO|PCS|PC|EA|KG|KGS|LTR|L)\s*(?:PER|/)\s*(?:DRUM|COIL|ROLL|BOX|PKT|BAG|CAN|SET|BUNDLE)",
    r"(?:DRUM|COIL|ROLL|BOX|PKT|BAG|CAN|SET|BUNDLE)\s*(?:OF\s*)?(\d+(?:\.\d+)?)\s*(MTR|M|MTRS|NOS|NO|PCS|PC|EA|KG|KGS|LTR|L)\b",
    r"(\d+(?:\.\d+)?)\s*(MTR|M|NOS|NO|PCS|KG|LTR)\s*(?:DRUM|COIL|ROLL|BOX|PKT|PACK)\b",
]

# Shorthand and what it stands for
SHORTHAND_ROWS = """
BRG | BEARING
BRGS | BEARINGS
BLT | BOLT
HEX | HEXAGON
HEXL | HEXAGONAL
HD | HEAD
THD | THREAD
THRD | THREAD
SS | STAINLESS STEEL
S/S | STAINLESS STEEL
SST | STAINLESS STEEL
STL | STEEL
CS | CARBON STEEL
MS | MILD STEEL
GALV | GALVANISED
GALVD | GALVANISED
GI | GALVANISED IRON
HDG | HOT DIP GALVANISED
ZP | ZINC PLATED
SCH | SCHEDULE
SCHD | SCHEDULE
NB | NOMINAL BORE
NPS | NOMINAL PIPE SIZE
DIA | DIAMETER
LG | LENGTH
LGTH | LENGTH
THK | THICKNESS
SQMM | SQ MM
SQ.MM | SQ MM
MM2 | SQ MM
CU | COPPER
AL | ALUMINIUM
XLPE | XLPE
PVC | PVC
ARMD | ARMOURED
UNARMD | UNARMOURED
FLGD | FLANGED
FLG | FLANGE
SW | SOCKET WELD
BW | BUTT WELD
SCRD | SCREWED
THRDD | THREADED
RF | RAISED FACE
FF | FLAT FACE
RTJ | RING TYPE JOINT
WN | WELD NECK
SO | SLIP ON
BLD | BLIND
GV | GATE VALVE
GLV | GLOBE VALVE
BV | BALL VALVE
CV | CHECK VALVE
NRV | NON RETURN VALVE
BFV | BUTTERFLY VALVE
SMLS | SEAMLESS
ERW | ERW
ASSY | ASSEMBLY
QTY | QUANTITY
MTL | MATERIAL
GR | GRADE
GRD | GRADE
STD | STANDARD
SPEC | SPECIFICATION
W/ | WITH
W/O | WITHOUT
SPL | SPECIAL
ELEC | ELECTRICAL
INSTR | INSTRUMENT
MECH | MECHANICAL
CPLG | COUPLING
RED | REDUCER
ECC | ECCENTRIC
CONC | CONCENTRIC
SW. | SOCKET WELD
SUPP | SUPPORT
GSKT | GASKET
GKT | GASKET
SPWD | SPIRAL WOUND
SWG | SPIRAL WOUND GASKET
TFE | PTFE
GRPH | GRAPHITE
OPRTD | OPERATED
HW | HAND WHEEL
GO | GEAR OPERATED
MO | MOTOR OPERATED
PN | PN
OD | OUTSIDE DIAMETER
ID | INSIDE DIAMETER
CL | CLASS
CLS | CLASS
"""

# Words without meaning of their own
NOISE = _list("FOR; OF; THE; AND; WITH; TO; AS; PER; IN; ON; AT; BY; NO; ITEM; MATERIAL; PART")

# Words of other scripts and of store language
LOCAL_WORDS = {
    "नट": "NUT",
    "बोल्ट": "BOLT",
    "पाइप": "PIPE",
    "वाल्व": "VALVE",
    "तार": "WIRE",
    "GOL": "ROUND",
    "PATTI": "STRIP",
    "CHADDAR": "SHEET",
}

# Family | label | citation | designations
FAMILY_ROWS = """
SS316 | AISI 316 molybdenum-bearing austenitic stainless steel | ASTM A240 / EN 10088-1 / UNS S31600 | 316; SS316; SS 316; SS-316; S316; AISI 316; AISI316; SUS316; UNS S31600; S31600; 1.4401; X5CRNIMO17-12-2; X5CrNiMo17-12-2; STAINLESS STEEL 316; SST 316; SS316 GRADE
SS316L | AISI 316L low-carbon austenitic stainless steel | ASTM A240 / EN 10088-1 / UNS S31603 | 316L; SS316L; SS 316L; UNS S31603; S31603; 1.4404; X2CRNIMO17-12-2
SS316TI | AISI 316Ti titanium-stabilised austenitic stainless steel | ASTM A240 / EN 10088-1 / UNS S31635 | 316TI; 316Ti; SS316TI; UNS S31635; 1.4571
SS304 | AISI 304 austenitic stainless steel | ASTM A240 / EN 10088-1 / UNS S30400 | 304; SS304; SS 304; SS-304; S304; AISI 304; SUS304; UNS S30400; S30400; 1.4301; X5CRNI18-10; STAINLESS STEEL 304
SS304L | AISI 304L low-carbon austenitic stainless steel | ASTM A240 / EN 10088-1 / UNS S30403 | 304L; SS304L; UNS S30403; S30403; 1.4307
CS_A105 | Carbon steel forgings for piping components (ASTM A105) | ASTM A105 / EN 10222-2 P250GH (1.0460) | A105; ASTM A105; A105N; SA105; SA-105; P250GH; 1.0460; C22.8
CS_A106B | Seamless carbon steel pipe for high-temperature service, Grade B | ASTM A106/A106M Grade B | A106 GR.B; A106 GRB; A106B; A106 GR B; ASTM A106 GR.B; SA106 GR.B; SA-106 GR B; A 106 GR.B
CS_GENERIC | Carbon steel, grade unspecified | grade unspecified - insufficient for identity | CS; CARBON STEEL; MS; MILD STEEL
IS2062_E250 | Hot rolled structural steel IS 2062 E250 | IS 2062:2011 Grade E250 | IS 2062 E250; IS2062 E250; E250; IS 2062 GR.A; IS2062
FC_A4 | ISO 3506 stainless fastener class A4 (molybdenum-bearing austenitic) | ISO 3506-1 Table 2 | A4; A-4; CLASS A4
FC_A2 | ISO 3506 stainless fastener class A2 (austenitic, no Mo) | ISO 3506-1 Table 2 | A2; A-2; CLASS A2
FC_A4_70 | ISO 3506 fastener class A4-70 (A4 material, 700 MPa min tensile) | ISO 3506-1 property class A4-70 | A4-70; A4 70; A470
FC_A4_80 | ISO 3506 fastener class A4-80 (A4 material, 800 MPa min tensile) | ISO 3506-1 property class A4-80 | A4-80; A4 80; A480
FC_A2_70 | ISO 3506 fastener class A2-70 | ISO 3506-1 property class A2-70 | A2-70; A2 70; A270
B7 | ASTM A193 Grade B7 alloy steel stud bolt | ASTM A193/A193M Grade B7 | B7; A193 B7; ASTM A193 B7; A193-B7; SA193 B7
B7M | ASTM A193 Grade B7M (sour-service tempered) | ASTM A193/A193M Grade B7M - NACE MR0175 acceptable | B7M; A193 B7M; ASTM A193 B7M
PC_8_8 | ISO 898-1 property class 8.8 carbon steel bolt | ISO 898-1 property class 8.8 | 8.8; CLASS 8.8; GR 8.8; GRADE 8.8; PROPERTY CLASS 8.8
PC_10_9 | ISO 898-1 property class 10.9 alloy steel bolt | ISO 898-1 property class 10.9 | 10.9; CLASS 10.9; GR 10.9; GRADE 10.9
PC_12_9 | ISO 898-1 property class 12.9 alloy steel bolt | ISO 898-1 property class 12.9 | 12.9; CLASS 12.9; GR 12.9
PTFE | Polytetrafluoroethylene | ASTM D4894 | PTFE; TEFLON; T.F.E; TFE
EPDM | Ethylene propylene diene monomer rubber | ASTM D2000 | EPDM; E.P.D.M
NBR | Nitrile butadiene rubber | ASTM D2000 | NBR; BUNA-N; BUNA N; NITRILE
XLPE | Cross-linked polyethylene insulation | IS 7098 / IEC 60502 | XLPE; X.L.P.E; XLPE INSULATED
CU | Electrolytic copper conductor | IS 8130 Class 2 | CU; COPPER; ELECTROLYTIC COPPER
AL | Aluminium conductor | IS 8130 | AL; ALUMINIUM; ALUMINUM
GRAPHITE | Flexible graphite | ASME B16.20 | GRAPHITE; FLEXIBLE GRAPHITE; GRAFOIL
WCB | ASTM A216 WCB cast carbon steel | ASTM A216/A216M Grade WCB | WCB; A216 WCB; ASTM A216 WCB; SA216 WCB
CF8M | ASTM A351 CF8M cast austenitic stainless (316 equivalent) | ASTM A351/A351M Grade CF8M | CF8M; A351 CF8M; ASTM A351 CF8M; SA351 CF8M
ARMOUR_GENERIC | Armoured cable, armour construction unspecified | IS 7098 Part 1 / IEC 60502-1 | ARMOURED; ARMORED; ARMD; ARMOUR; ARMOR
ARMOUR_SWA | Galvanised steel wire armour | IS 3975 / IEC 60502-1 - round galvanised steel wire armour | SWA; STEEL WIRE ARMOUR; STEEL WIRE ARMOURED; GSWA
ARMOUR_STA | Galvanised steel strip armour | IS 3975 / IEC 60502-1 - formed steel strip armour | STA; STEEL STRIP ARMOUR; STEEL STRIP ARMOURED; GSSA
ARMOUR_NONE | Unarmoured cable | IS 7098 Part 1 - no armour layer | UNARMOURED; UNARMORED; UNARMD; PLAIN SHEATH
"""

# Family | family | kind of link | partial | citation
LINK_ROWS = """
FC_A4_70 | FC_A4 | memberOf |  | ISO 3506-1: A4-70 is property class 70 of material group A4
FC_A4_80 | FC_A4 | memberOf |  | ISO 3506-1: A4-80 is property class 80 of material group A4
FC_A2_70 | FC_A2 | memberOf |  | ISO 3506-1: A2-70 is property class 70 of material group A2
FC_A4 | SS316 | gradeSatisfiedBy | partial | ISO 3506-1 Table 2 - class A4 is molybdenum-bearing austenitic, admits 316, 316L and 316Ti, so the mapping is one-to-many
FC_A4 | SS316L | gradeSatisfiedBy | partial | ISO 3506-1 Table 2 - class A4 admits 316L
FC_A4 | SS316TI | gradeSatisfiedBy | partial | ISO 3506-1 Table 2 - class A4 admits 316Ti
FC_A2 | SS304 | gradeSatisfiedBy | partial | ISO 3506-1 Table 2 - class A2 is austenitic without Mo, admits 304 and 304L
FC_A2 | SS304L | gradeSatisfiedBy | partial | ISO 3506-1 Table 2 - class A2 admits 304L
SS316L | SS316 | variantOf | partial | 316L is the low-carbon variant of 316, interchangeable only where carbon content is not a stated requirement
SS304L | SS304 | variantOf | partial | 304L is the low-carbon variant of 304
CF8M | SS316 | castEquivalentOf | partial | ASTM A351 CF8M is the cast equivalent of wrought 316, not interchangeable where wrought product form is specified
CS_A105 | CS_GENERIC | memberOf |  | A105 is a specific carbon steel forging grade
CS_A106B | CS_GENERIC | memberOf |  | A106 Gr.B is a specific carbon steel pipe grade
IS2062_E250 | CS_GENERIC | memberOf |  | IS 2062 E250 is a specific structural carbon steel grade
B7M | B7 | sourServiceVariantOf | partial | ASTM A193 B7M is the hardness-controlled variant of B7 for NACE MR0175 sour service, B7 does not substitute for B7M
ARMOUR_SWA | ARMOUR_GENERIC | memberOf | partial | IEC 60502-1 - steel wire armour is one armour construction, a record stating only 'armoured' does not specify which
ARMOUR_STA | ARMOUR_GENERIC | memberOf | partial | IEC 60502-1 - steel strip armour is one armour construction, a record stating only 'armoured' does not specify which
"""

# Scale | values from low to high | equal values | whether higher serves for lower | attributes that must agree | citation | caveat | caveat of equal values
SCALE_ROWS = """
pipe_schedule | SCH5; SCH5S; SCH10; SCH10S; SCH20; SCH30; SCH40; SCH40S; STD; SCH60; SCH80; SCH80S; XS; SCH100; SCH120; SCH140; SCH160; XXS | SCH40=STD; SCH80=XS; SCH40=SCH40S; SCH80=SCH80S; SCH5=SCH5S; SCH10=SCH10S | yes |  | ASME B36.10M / B36.19M | Thicker wall gives the same outside diameter under ASME B36.10M but a smaller bore and greater weight. Check hydraulic and support-loading impact before substituting. | STD equals SCH40 only up to NPS 10; XS equals SCH80 only up to NPS 8. Above those sizes the wall thicknesses diverge.
property_class | 4.6; 4.8; 5.6; 5.8; 6.8; 8.8; 9.8; 10.9; 12.9 |  | yes |  | ISO 898-1 | Higher property class raises tensile strength but lowers ductility and changes the tightening torque. Re-issue the torque specification before substituting. | 
ss_fastener_class | A2-50; A2-70; A2-80; A4-50; A4-70; A4-80 |  | no |  | ISO 3506-1 | A2 and A4 are different material groups, not grades of one scale. Only compare within the same group. | 
pressure_class | 150; 300; 400; 600; 900; 1500; 2500 |  | yes | end_connection; nominal_size | ASME B16.5 / B16.34 | A higher pressure class only substitutes when the end connection and face-to-face dimensions match. Flange bolt circles differ between classes under ASME B16.5, so a higher-class flange does not bolt to a lower-class one. | 
cable_voltage | 650V; 1100V; 3.3KV; 6.6KV; 11KV; 33KV |  | yes |  | IS 7098 / IEC 60502 | Higher voltage grade means thicker insulation and a larger overall diameter - check gland and tray sizing. | 
"""

# Service qualifier | label | citation | names
SERVICE_ROWS = """
NACE_MR0175 | Sour service qualification | NACE MR0175 / ISO 15156 | NACE MR0175; NACE MR-0175; MR0175; ISO 15156; NACE; SOUR SERVICE; SOUR
ATEX | Explosive atmosphere certification | IEC 60079 / ATEX 2014/34/EU | ATEX; IECEX; IEC EX; EX D; EXD; FLAMEPROOF; FLP
FIRE_SAFE | Fire-safe valve design | API 607 / API 6FA | FIRE SAFE; FIRESAFE; API 607; API 6FA
OXYGEN_CLEAN | Cleaned for oxygen service | ASTM G93 | OXYGEN CLEAN; O2 CLEAN; OXYGEN SERVICE
"""

# Withdrawn standard | its successor | citation
SUPERSEDED_ROWS = """
IS 1367 PART 3 1979 | IS 1367 PART 3 2002 | IS 1367-3 revised 2002
ISO 3506:1997 | ISO 3506-1:2020 | ISO 3506 split into parts and revised 2020
BS 3692 | ISO 4014 | BS 3692 withdrawn, superseded by ISO 4014 for hexagon head bolts
DIN 933 | ISO 4017 | DIN 933 superseded by ISO 4017 (fully threaded hexagon head screws)
DIN 931 | ISO 4014 | DIN 931 superseded by ISO 4014 (partially threaded hexagon head bolts)
DIN 934 | ISO 4032 | DIN 934 superseded by ISO 4032 (hexagon nuts style 1)
"""

GENERIC = "GENERIC"
VERSION = "1.0.0"


@dataclass(frozen=True)
class Attribute:
    """One attribute of a class, in the order in which attributes are compared and shown."""

    code: str
    ord: int
    key: str
    label: str
    unit: str
    flags: str
    scale: str

    def has(self, flag: str) -> bool:
        return flag in self.flags


@dataclass(frozen=True)
class ItemClass:
    code: str
    item_name: str
    nsc: str
    unspsc: str
    hsn: str
    eclass: str
    keywords: tuple[str, ...]
    attributes: tuple[Attribute, ...]

    def keys(self, flag: str = "") -> list[str]:
        return [a.key for a in self.attributes if flag in a.flags]


def _classes() -> dict[str, ItemClass]:
    by_class: dict[str, list[Attribute]] = {}
    for code, key, label, unit, flags, scale in _rows(ATTRIBUTE_ROWS):
        of = by_class.setdefault(code, [])
        of.append(Attribute(code, len(of), key, label, unit, flags, scale))
    return {r[0]: ItemClass(*r[:6], tuple(_list(r[6])), tuple(by_class[r[0]])) for r in _rows(CLASS_ROWS)}


CLASSES = _classes()
BASES = {d: b for d, b in _rows(BASE_ROWS)}
UNITS = {r[0]: (r[1], float(r[2]), _list(r[3])) for r in _rows(UNIT_ROWS)}
PACKS = {r[0]: (r[1], float(r[2]), r[3], _list(r[4])) for r in _rows(PACK_ROWS)}
SHORTHAND = {s: w for s, w in _rows(SHORTHAND_ROWS)}
FAMILIES = {r[0]: (r[1], r[2], _list(r[3])) for r in _rows(FAMILY_ROWS)}
LINKS = [(r[0], r[1], r[2], bool(r[3]), r[4]) for r in _rows(LINK_ROWS)]
SCALES = {r[0]: {"values": _list(r[1]), "equal": [tuple(e.split("=")) for e in _list(r[2])], "serves": r[3] == "yes", "requires": _list(r[4]), "citation": r[5], "caveat": r[6], "equal_caveat": r[7]} for r in _rows(SCALE_ROWS)}
SERVICES = {r[0]: (r[1], r[2], _list(r[3])) for r in _rows(SERVICE_ROWS)}
SUPERSEDED = [tuple(r) for r in _rows(SUPERSEDED_ROWS)]
