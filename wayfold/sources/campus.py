"""The links of one campus as an inline table: where tunnels, bridges and doorways join its buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, ends, kind, height, status, whether verified, metres, first and last place (map data by OpenStreetMap contributors).
LINKS = """
sch-tc,SCH,TC,tunnel,-4,open,1,57,-80.5405341,43.4690219,-80.541154,43.4689081
tc-al,TC,AL,tunnel,-4,open,1,74,-80.541154,43.4689081,-80.5416198,43.4688586
al-ml,AL,ML,tunnel,-4,open,1,57,-80.5420502,43.4687855,-80.5426133,43.4688019
al-ev1,AL,EV1,tunnel,-4,open,1,47,-80.5420502,43.4687855,-80.542305,43.4685357
ev1-hh,EV1,HH,tunnel,-4,open,1,26,-80.5422379,43.4682649,-80.542013,43.4681337
mc-c2,MC,C2,tunnel,-4,open,1,25,-80.5436179,43.4720504,-80.5433272,43.4721026
rch-e2,RCH,E2,tunnel,-4,open,1,28,-80.5407909,43.4704448,-80.5407559,43.4706329
rch-dwe,RCH,DWE,tunnel,-4,open,1,35,-80.5407427,43.4701735,-80.5405579,43.4698866
esc-eit-t,ESC,EIT,tunnel,-4,open,1,12,-80.5425589,43.4712479,-80.5424309,43.4711928
phy-e2-t,PHY,E2,tunnel,-4,open,0,21,-80.5411923,43.4704676,-80.5409614,43.4705513
qnc-b2-t,QNC,B2,tunnel,-4,open,0,139,-80.5438743,43.4714565,-80.5439711,43.4707214
slc-mc,SLC,MC,bridge,5,open,1,51,-80.5450054,43.4720948,-80.5444417,43.4723015
pac-slc,PAC,SLC,bridge,8,open,1,42,-80.5459461,43.4720419,-80.5454898,43.4718845
mc-dc,MC,DC,bridge,5,open,1,54,-80.5437408,43.4724154,-80.5432061,43.4726353
dc-m3,DC,M3,bridge,5,open,1,53,-80.5434356,43.4727806,-80.5438726,43.4731174
dc-c2,DC,C2,bridge,5,open,1,39,-80.5424388,43.4724099,-80.5428191,43.4722081
dc-e3,DC,E3,bridge,5,open,1,12,-80.5413073,43.4718838,-80.5412098,43.4718019
e3-e5,E3,E5,bridge,6,open,1,93,-80.5404796,43.4719161,-80.539903,43.4725277
pse-e6,PSE,E6,bridge,6,open,1,42,-80.5393241,43.4730211,-80.5388533,43.4731879
e2-dwe,E2,DWE,bridge,5,open,1,26,-80.539877,43.4703425,-80.5397224,43.4701389
e2-phy,E2,PHY,bridge,5,open,1,18,-80.5410112,43.4706234,-80.5412148,43.4706449
esc-eit-b,ESC,EIT,bridge,5,open,1,83,-80.5425589,43.4712479,-80.5424309,43.4711928
mc-qnc,MC,QNC,bridge,5,open,1,34,-80.5440066,43.4718433,-80.5439068,43.4715702
e2-e3,E2,E3,bridge,5,open,1,15,-80.5402455,43.4713284,-80.5403246,43.4714537
c2-esc,C2,ESC,bridge,5,open,0,22,-80.5430164,43.4719361,-80.5429994,43.4717487
ev2-ev3,EV2,EV3,bridge,5,open,1,49,-80.5434528,43.467765,-80.5431454,43.4677677
ev2-pas,EV2,PAS,bridge,5,open,0,38,-80.5430138,43.4679922,-80.542716,43.4677918
stc-nh,STC,NH,bridge,5,open,0,32,-80.5437,43.4704413,-80.5436994,43.4701595
cph-lota,CPH,Lot A,bridge,8,closed,1,77,-80.5388767,43.4706048,-80.5380141,43.4703182
ev1-ev2,EV1,EV2,doorway,1,open,1,12,-80.5429059,43.4681198,-80.5430167,43.4680475
eit-phy,EIT,PHY,doorway,1,open,1,12,-80.5420794,43.4713652,-80.5420235,43.4712646
b1-b2,B1,B2,doorway,1,open,1,12,-80.5431895,43.4708308,-80.5433329,43.4708024
b2-stc,B2,STC,doorway,1,open,1,12,-80.5439535,43.4706023,-80.5440748,43.4705397
b1-stc,B1,STC,doorway,1,open,1,12,-80.5429201,43.4704437,-80.5430676,43.4704568
e5-pse,E5,PSE,doorway,1,open,1,24,-80.5397667,43.4726763,-80.5395973,43.4727072
e2-cph,E2,CPH,doorway,1,open,1,12,-80.5398556,43.4710915,-80.5397344,43.4711542
"""


def links(spark: SparkSession) -> DataFrame:
    """(id, from, to, kind, z_m, name, status, verified, notes, length_m, geom): a straight line between a link's two portals."""
    text = spark.createDataFrame([(x,) for x in LINKS.split("\n") if x], "line string")
    row = F.from_csv("line", F.lit("id string, from string, to string, kind string, z_m int, status string, verified int, length_m int, ax double, ay double, bx double, by double"))
    r = text.select(row.alias("r")).select("r.*")
    at = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    none = F.lit(None).cast("string")
    return r.select("id", "from", "to", "kind", "z_m", F.concat_ws(" – ", "from", "to").alias("name"), "status", (F.col("verified") == 1).alias("verified"), none.alias("notes"), "length_m", F.array(at("ax", "ay"), at("bx", "by")).alias("geom"))
