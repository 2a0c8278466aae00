"""Synthetic property-list captures."""

import plistlib

from linklore.sources import probes

NET = "spairport_network_"


def document(iface):
    return plistlib.dumps(
        [{"_dataType": "SPAirPortDataType", "_items": [{"spairport_airport_interfaces": [{"_name": "awdl0"}, iface]}]}]
    )


def entry(name=None, bssid=None, signal=None, channel=None, **more):
    fields = {"_name": name, NET + "bssid": bssid, "spairport_signal_noise": signal, NET + "channel": channel}
    return {k: v for k, v in {**fields, **more}.items() if v is not None}


LINK, OTHERS = "spairport_current_network_information", "spairport_airport_other_local_wireless_networks"
DOCS = {
    "joined": document({
        "_name": "en0",
        LINK: entry("Cafe", "AA:BB:CC:00:00:01", "-42 dBm / -97 dBm", "149 (5GHz, 80MHz)", **{NET + "rate": 866, "spairport_security_mode": "spairport_security_mode_wpa2_personal"}),
        OTHERS: [entry("Guest", "AA:00", "-60 dBm / -90 dBm", "37 (6GHz, 160MHz)"), entry(channel="6"), {"spairport_security_mode": "wpa"}],
    }),
    "hidden": document({"_name": "en0", LINK: entry("<redacted>", None, "-58 dBm / -90 dBm", "36"), OTHERS: []}),
    "noise": document({"_name": "en0", LINK: {NET + "type": "station"}}),
    "off": document({"_name": "en0", "spairport_status_information": "spairport_status_off"}),
    "missing": document({"_name": "en5"}),
    "broken": b"<plist><nope",
}


def test_captures(spark, tmp_path):
    for name, content in DOCS.items():
        (tmp_path / name).write_bytes(content)
    parts = probes.capture_parts(probes.read_captures(spark, str(tmp_path))).cache()

    def rows(df):
        return {r.capture_id.rsplit("/", 1)[1]: r for r in df.collect()}

    links = rows(probes.capture_links(parts))
    assert set(links) == {"joined", "hidden"}
    j = links["joined"]
    assert (j.ssid, j.bssid, j.rssi_dbm, j.noise_dbm) == ("Cafe", "aa:bb:cc:00:00:01", -42, -97)
    assert (j.channel_number, j.channel_band, j.channel_width) == (149, "FiveGhz", "Mhz80")
    assert (j.tx_rate_mbps, j.security, j.confidence) == (866.0, "Wpa2", "Direct")
    assert (links["hidden"].ssid, links["hidden"].confidence) == (None, "Inferred")
    heard = probes.capture_neighbors(parts).orderBy("pos").collect()
    assert [(r.channel_number, r.channel_band, r.confidence) for r in heard] == [
        (37, "SixGhz", "Direct"), (6, "TwoPointFourGhz", "Inferred"),
    ]
    assert {k: r.n_neighbors for k, r in rows(probes.capture_scans(parts)).items()} == {"joined": 2, "hidden": 0}
    assert {k: r.state for k, r in rows(probes.capture_health(parts)).items()} == {
        "joined": "Operational", "hidden": "Operational", "noise": "Operational", "off": "HardwareDisabled",
        "missing": "BackendUnavailable", "broken": "ParseFailed",
    }
