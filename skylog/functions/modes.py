"""Operating modes: shown mode, duplicate-key mode, receiver modes, default reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col, reused, upper_filled

# ADIF 3.1.7 modes whose submodes are variants of the mode.
VARIANTS = {
    "CHIP": ("CHIP64", "CHIP128"),
    "CW": ("PCW",),
    "DOMINO": (
        "DOM-M", "DOM4", "DOM5", "DOM8", "DOM11", "DOM16", "DOM22", "DOM44", "DOM88", "DOMINOEX", "DOMINOF",
    ),
    "DYNAMIC": ("FREEDATA", "VARA HF", "VARA SATELLITE", "VARA FM 1200", "VARA FM 9600"),
    "FSK": ("SCAMP_FAST", "SCAMP_SLOW", "SCAMP_VSLOW"),
    "HELL": (
        "FMHELL", "FSKH105", "FSKH245", "FSKHELL", "HELL80", "HELLX5", "HELLX9", "HFSK", "PSKHELL",
        "SLOWHELL",
    ),
    "ISCAT": ("ISCAT-A", "ISCAT-B"),
    "JT4": ("JT4A", "JT4B", "JT4C", "JT4D", "JT4E", "JT4F", "JT4G"),
    "JT65": ("JT65A", "JT65B", "JT65B2", "JT65C", "JT65C2"),
    "JT9": (
        "JT9-1", "JT9-2", "JT9-5", "JT9-10", "JT9-30", "JT9A", "JT9B", "JT9C", "JT9D", "JT9E", "JT9E FAST",
        "JT9F", "JT9F FAST", "JT9G", "JT9G FAST", "JT9H", "JT9H FAST",
    ),
    "MTONE": ("SCAMP_OO", "SCAMP_OO_SLW"),
    "OFDM": ("RIBBIT_PIX", "RIBBIT_SMS"),
    "OLIVIA": (
        "OLIVIA 4/125", "OLIVIA 4/250", "OLIVIA 8/250", "OLIVIA 8/500", "OLIVIA 16/500", "OLIVIA 16/1000",
        "OLIVIA 32/1000",
    ),
    "OPERA": ("OPERA-BEACON", "OPERA-QSO"),
    "PAC": ("PAC2", "PAC3", "PAC4"),
    "PAX": ("PAX2",),
    "PSK": (
        "8PSK125", "8PSK125F", "8PSK125FL", "8PSK250", "8PSK250F", "8PSK250FL", "8PSK500", "8PSK500F",
        "8PSK1000", "8PSK1000F", "8PSK1200F", "FSK31", "PSK10", "PSK31", "PSK63", "PSK63F", "PSK63RC4",
        "PSK63RC5", "PSK63RC10", "PSK63RC20", "PSK63RC32", "PSK125", "PSK125C12", "PSK125R", "PSK125RC10",
        "PSK125RC12", "PSK125RC16", "PSK125RC4", "PSK125RC5", "PSK250", "PSK250C6", "PSK250R", "PSK250RC2",
        "PSK250RC3", "PSK250RC5", "PSK250RC6", "PSK250RC7", "PSK500", "PSK500C2", "PSK500C4", "PSK500R",
        "PSK500RC2", "PSK500RC3", "PSK500RC4", "PSK800C2", "PSK800RC2", "PSK1000", "PSK1000C2", "PSK1000R",
        "PSK1000RC2", "PSKAM10", "PSKAM31", "PSKAM50", "PSKFEC31", "QPSK31", "QPSK63", "QPSK125", "QPSK250",
        "QPSK500", "SIM31",
    ),
    "QRA64": ("QRA64A", "QRA64B", "QRA64C", "QRA64D", "QRA64E"),
    "ROS": ("ROS-EME", "ROS-HF", "ROS-MF"),
    "RTTY": ("ASCI",),
    "SSB": ("LSB", "USB"),
    "THOR": (
        "THOR-M", "THOR4", "THOR5", "THOR8", "THOR11", "THOR16", "THOR22", "THOR25X4", "THOR50X1",
        "THOR50X2", "THOR100",
    ),
    "THRB": ("THRBX", "THRBX1", "THRBX2", "THRBX4", "THROB1", "THROB2", "THROB4"),
    "TOR": ("AMTORFEC", "GTOR", "NAVTEX", "SITORB"),
}

# Receiver mode -> (mode, submode); modes not listed are ambiguous.
RECEIVER_MODES = {
    "USB": ("SSB", ""),
    "LSB": ("SSB", ""),
    "CW": ("CW", ""),
    "CWR": ("CW", ""),
    "CWN": ("CW", ""),
    "AM": ("AM", ""),
    "AMN": ("AM", ""),
    "AMS": ("AM", ""),
    "SAM": ("AM", ""),
    "SAL": ("AM", ""),
    "SAH": ("AM", ""),
    "FM": ("FM", ""),
    "FMN": ("FM", ""),
    "WFM": ("FM", ""),
    "RTTY": ("RTTY", ""),
    "RTTYR": ("RTTY", ""),
    "PSK": ("PSK", ""),
    "PSKR": ("PSK", ""),
    "FAX": ("FAX", ""),
    "C4FM": ("DIGITALVOICE", "C4FM"),
    "D-STAR": ("DIGITALVOICE", "DSTAR"),
    "DPMR": ("DIGITALVOICE", ""),
    "NXDN-VN": ("DIGITALVOICE", ""),
    "NXDN-N": ("DIGITALVOICE", ""),
    "DCR": ("DIGITALVOICE", ""),
    "P25": ("DIGITALVOICE", ""),
}
# Receiver data modes, spelling aliases, phone and dB-report modes.
DATA_MODES = ["PKTUSB", "PKTLSB", "PKTFM", "PKTAM", "PKTFMN"]
ALIASES = {
    "AM-D": "PKTAM",
    "FM-D": "PKTFM",
    "CW-R": "CWR",
    "RTTY-R": "RTTYR",
    "LSB-D": "PKTLSB",
    "USB-D": "PKTUSB",
    "DSTAR": "D-STAR",
}
PHONE = [
    "SSB", "USB", "LSB", "AM", "FM", "DIGITALVOICE", "C4FM", "DMR", "DSTAR", "FREEDV", "M17",
]
DB_REPORT = [
    "FT8", "FT4", "FST4", "JS8", "Q65", "JT65", "JT65A", "JT65B", "JT65C", "JT9", "JT4", "MSK144", "QRA64",
]
# Submodes an operator may type by their own name, by parent mode.
TYPED_SUBMODES = {
    "SSB": ("USB", "LSB"),
    "MFSK": ("FT4", "FST4", "JS8", "Q65", "MFSK16"),
    "PSK": ("PSK31", "PSK63", "PSK125", "QPSK31"),
    "DIGITALVOICE": ("C4FM", "DMR", "DSTAR", "FREEDV", "M17"),
    "JT65": ("JT65A", "JT65B", "JT65C"),
    "OLIVIA": ("OLIVIA 4/250", "OLIVIA 8/250", "OLIVIA 8/500", "OLIVIA 16/500", "OLIVIA 32/1000"),
    "HELL": ("FMHELL", "FSKHELL", "HELL80"),
}


def parent_of(name: Column | str, families: dict[str, tuple[str, ...]], own: bool) -> Column:
    """The key of ``families`` whose list holds ``name``: hash probes in one CASE.

    ``own`` also lets a key stand for itself.
    """
    members = {p: [*([p] if own else []), *names] for p, names in families.items()}
    if isinstance(name, str):
        cases = (
            f"WHEN {name} IN ({', '.join(repr(n) for n in names)}) THEN '{parent}'"
            for parent, names in members.items()
        )
        return F.expr(f"CASE {' '.join(cases)} END")
    return F.coalesce(*[F.when(name.isin(names), F.lit(p)) for p, names in members.items()])


@reused
def display_mode(mode: Column | str, submode: Column | str) -> Column:
    """What a user sees: the submode when there is one, else the mode, '' for neither."""
    return F.coalesce(upper_filled(submode), upper_filled(mode), F.lit(""))


@reused
def dedup_mode(mode: Column | str, submode: Column | str, clean: bool = False) -> Column:
    """One value per contact however a logger spells its mode.

    ``clean`` says that both are upper-case names without blanks already.
    """
    main, sub = (mode, submode) if clean else (upper_filled(mode), upper_filled(submode))
    family = [parent_of(name, VARIANTS, own=True) for name in (main, sub)]
    main, sub = col(main), col(sub)
    with_mode = F.coalesce(family[0], sub, main)
    return F.when(main.isNotNull(), with_mode).otherwise(F.coalesce(family[1], sub, F.lit("")))


@reused
def receiver_mode(text: Column | str) -> Column:
    """Canonical receiver mode name, '' for blank."""
    name = F.coalesce(upper_filled(text), F.lit(""))
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in ALIASES.items()], name)


def is_data_mode(text: Column | str) -> Column:
    return receiver_mode(text).isin(DATA_MODES)


def receiver_mode_table(spark: SparkSession) -> DataFrame:
    """Receiver mode -> (mode, submode) as a dimension of 26 rows."""
    rows = [(k, *v) for k, v in RECEIVER_MODES.items()]
    return spark.createDataFrame(rows, "rig_mode string, adif_mode string, adif_submode string")


def join_receiver_modes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``rig_mode, is_data, adif_mode, adif_submode`` (NULL when ambiguous)."""
    named = df.withColumn("rig_mode", receiver_mode(text)).withColumn(
        "is_data", F.col("rig_mode").isin(DATA_MODES)
    )
    return named.join(F.broadcast(receiver_mode_table(df.sparkSession)), "rig_mode", "left")


@reused
def split_mode(text: Column | str) -> Column:
    """Operator text -> struct(mode, submode): a known submode gets its parent."""
    name = F.coalesce(upper_filled(text), F.lit(""))
    parent = parent_of(name, TYPED_SUBMODES, own=False)
    return F.struct(
        F.coalesce(parent, name).alias("mode"),
        F.when(parent.isNotNull(), name).otherwise(F.lit("")).alias("submode"),
    )


@reused
def default_rst(mode: Column | str, submode: Column | str) -> Column:
    """Usual report: -10 for dB modes, 59 for phone, 599 otherwise, '' without a mode."""
    pair = split_mode(mode)
    sub = F.coalesce(upper_filled(submode), F.nullif(pair["submode"], F.lit("")))
    main = F.nullif(pair["mode"], F.lit(""))

    def report(name: Column) -> Column:
        return F.when(name.isin(DB_REPORT), F.lit("-10")).when(name.isin(PHONE), F.lit("59"))

    rest = F.when(F.coalesce(sub, main).isNotNull(), F.lit("599")).otherwise(F.lit(""))
    return F.coalesce(report(sub), report(main), rest)

