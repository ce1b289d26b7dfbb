"""Digests (``licenses.digest``) of the normalised full texts of common licences, with the usual variants: with and without
the appendix or exhibits, Apache-2.0 also without its title and with the copyright line filled in, Unlicense also with a title."""

#: Licence to the digests of its texts.
DIGESTS = {
    "Apache-2.0": [
        "144b7967891d99a420cebe46ce47bbc7",
        "47b515994eae3a3112a7dafacc3fc11e",
        "51198fd9c2975fb7c490a0a5f11505d4",
        "6255f870e6a9bb331f8ec39fb3076723",
        "8e97f905cf0ceca0b3e8ba9a3a75d977",
        "96e2f6a9dcc346917f6a6fb2bff883b5",
        "a2e6968ec0f66ba2d873158ad347ce6d",
    ],
    "Artistic-1.0-Perl": [
        "01297679267ad921516667ccd889865e",
    ],
    "CC-BY-SA-4.0": [
        "523e1ae67034d876937bf1d3b440b9ea",
    ],
    "CC0-1.0": [
        "93a180096f6cfcf2c0dd24f75c2eec48",
    ],
    "GFDL-1.2-only": [
        "5c090589d1262f22baa878643ecc50ce",
    ],
    "GFDL-1.3-only": [
        "329b1f467bc449a3e369fe846576b1be",
    ],
    "GPL-1.0-only": [
        "8cc28d08e8e3451e3d75b264ec268c84",
        "b0020d662a90ee8e71d30676953d3411",
        "f42708352560f9694e1c638f8f0541ad",
    ],
    "GPL-2.0-only": [
        "1fef7bcad23b4debe02734e344878b81",
        "55b3f8b80975cbf491a061c93fcd72c7",
        "96b7bb5f1b6f28e923aba29da924d2bf",
        "98dbad3fe0dea274bd81c47ba2520608",
        "c363704d7a69ed0f8787b4a7c37b7489",
        "c57323a5c7eda72364a4f7d6fb8d9bc0",
    ],
    "GPL-3.0-only": [
        "0a24056bdfef5ebdbb798e19911f6441",
        "65583fd95133cdfd0468bbf8840f9a2b",
        "c788c5e1f8377b2ac04e5ce8b6ac22c2",
        "c8f8417bcfb24fb1bb053e565ecb74fc",
        "d0f6bf1d81185d4d672090ac9aa49a21",
        "fbde6c71be83a67ad37e22d3f0a6b5e9",
    ],
    "LGPL-2.0-only": [
        "48ea78bd6dd95bb0fa6062876ff0131f",
        "ab141a40b4d77a27a235fb85cd212f61",
        "b21124c7e854f1711bb8b15da9666299",
    ],
    "LGPL-2.1-only": [
        "58cd988ea3ea62499c61566580124950",
        "bf84c378a9d15776dfc8e5a81230ee74",
        "c87263f0eba1131827be55f7be53ca11",
    ],
    "LGPL-3.0-only": [
        "b31b7335bc37919e8cdd79154e04d88d",
    ],
    "MPL-1.1": [
        "42f9588dde2c7c886167ed6c55291512",
    ],
    "MPL-2.0": [
        "3dc885bd12cde2d7ba58e21397254280",
        "b8d3ee3eb19e9dce738ae0330c039f42",
    ],
    "OFL-1.1": [
        "b6ae2c68c282bbee8510459882edd65e",
    ],
    "Unlicense": [
        "2e55665719d2daa9d055bc6f171a56df",
        "a8d9afd57ab672faaa23a52bb9f33aca",
        "b9854f8d0d9bb3bd6e39a84d437fe6c1",
        "bbfeb2bae78ee0aad8e07be974399865",
        "c68f4ff6fa12e3dc13ef3d6a67552882",
        "d90e4bb75f3a9de8f8cfd631e50dca1c",
    ],
}
