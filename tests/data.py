"""The data set of the tests: a network of river gauges, their sensors and what these have read."""

from strata.plans.manifest import Entity, Field, Kind, Lookup, Manifest, Missing


def gauges(**basin) -> Manifest:
    reading = Entity(
        "Reading", "Readings", schema="hydro", key_column="ReadingKey", parent_key_column="SensorKey", natural_key=("At",),
        fields=(Field("At", type=Kind.DATETIME, required=True), Field("Level", type=Kind.DOUBLE), Field("Flag", max_length=8, default="raw")),
    )
    sensor = Entity(
        "Sensor", "Sensors", schema="hydro", key_column="SensorKey", parent_key_column="GaugeKey", natural_key=("Slot",),
        fields=(Field("Slot", type=Kind.INT32, required=True), Field("Model"), Field("Active", type=Kind.BOOLEAN, default="yes")), children=(reading,),
    )
    gauge = Entity(
        "Gauge", "Gauges", schema="hydro", key_column="GaugeKey", natural_key=("Code",),
        fields=(
            Field("Code", required=True, max_length=12), Field("Basin", column="BasinId", lookup=Lookup("basins", **basin)),
            Field("Opened", type=Kind.DATE, format="dd.MM.yyyy"), Field("Height", type=Kind.DECIMAL, precision=9, scale=3),
        ),
        children=(sensor,),
    )
    return Manifest("gauges", root=gauge)


def auto() -> Manifest:
    return gauges(on_missing=Missing.AUTO_CREATE)


def soils() -> Manifest:
    """One level: samples of soil, some of whose readings are blank."""
    fields = (Field("Plot", required=True), Field("Depth", type=Kind.DECIMAL, precision=5, scale=1), Field("Place"), Field("Acid", type=Kind.DOUBLE))
    return Manifest("soils", root=Entity("Sample", "Samples", natural_key=("Plot", "Depth"), fields=fields))


#: One good tree of five records; an unknown basin, an unreadable height and, two levels down, an unreadable time.
NETWORK = """<?xml version="1.0"?>
<Network>
  <Gauge>
    <Code>RH-07</Code><Basin>rhine</Basin><Opened>03.11.1987</Opened><Height>212.25</Height>
    <Sensor><Slot>4</Slot><Model>radar</Model><Active>no</Active>
      <Reading><At>2026-03-01 06:00</At><Level>1.75</Level></Reading>
      <Reading><At>2026-03-01 06:15</At><Level>1.5</Level><Flag>checked</Flag></Reading>
    </Sensor>
    <Sensor><Slot>5</Slot></Sensor>
  </Gauge>
  <Gauge><Code>XX-01</Code><Basin>amazon</Basin>
    <Sensor><Slot>1</Slot></Sensor></Gauge>
  <Gauge><Code>OD-03</Code><Basin>Oder</Basin><Height>high</Height></Gauge>
  <Gauge><Code>OD-04</Code><Basin>ODER</Basin>
    <Sensor><Slot>1</Slot><Reading><At>noon</At></Reading></Sensor></Gauge>
</Network>"""
