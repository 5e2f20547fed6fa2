"""Digests of the canonical forms of full licences, with and without their appendix, by older and newer addresses."""

from __future__ import annotations

#: SPDX identifier by digest.  Fixed values, made from the texts that Debian ships as common licences.
DIGESTS: dict[str, str] = {
    "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052": "Apache-2.0",
    "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793": "Apache-2.0",
    "0c625737207ff21211498d94941901de5bca68c965547007c169a1e718b97f16": "Apache-2.0",
    "f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c": "Apache-2.0",
    "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6": "GPL-2.0",
    "9f871ce679a9dd4c702298774a45f34fe5dda57aaa9492c1214c525d59a72b16": "GPL-2.0",
    "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0": "GPL-2.0",
    "ebd4f0d228fbcd41efd19a83a933502ccc7f758b9c0acdf5b6400819af646b75": "GPL-2.0",
    "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef": "GPL-2.0",
    "98794544236d8bd42ecfabccd016accb5e3b0238ad126c9cfb1da6c065fa8da4": "GPL-2.0",
    "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1": "GPL-3.0",
    "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8": "GPL-3.0",
    "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b": "GPL-3.0",
    "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153": "GPL-3.0",
    "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692": "LGPL-2.1",
    "47bbccf6366d9e2c22a49053b6b29fad4be370052d707ef979ecb3b0b0e60d00": "LGPL-2.1",
    "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97": "LGPL-2.1",
    "78e6e94dac14ff5250f6d61437ce8dacb06ab3b29a7d0b4607a8b7ce23c8443e": "LGPL-2.1",
    "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30": "LGPL-2.1",
    "80cd981b9cdab549d0f18661a573243be4f7c58b4277dd505dbaabd322c12fb1": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
    "c4f374e2647dfb8c880ead23b49e0bd6e8c490d3a2cf9b4ed36426bad15f6e1a": "MPL-2.0",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a": "CC0-1.0",
}
