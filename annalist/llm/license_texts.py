"""Wording of public license notices: titles, and the notices and conditions that stand without one.

A title makes short notices by rule: "licensed under the <title>" and "under the terms of the
<title>". Fixed values throughout.
"""

# The titles of licenses, by SPDX identifier.
TITLES: dict[str, list[str]] = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3", "GNU AGPLv3"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "CDDL 1.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public License, Version 1.2", "European Union Public License 1.2", "EUPL 1.2 License"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3", "GNU Free Documentation License 1.3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2 License", "GNU GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3 License", "GNU GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1 License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3 License"],
    "LPPL-1.3c": ["LaTeX Project Public License, version 1.3c"],
    "MIT": ["MIT License", "Expat License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "MS-PL": ["Microsoft Public License", "MS-PL License"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA License"],
    "ODbL-1.0": ["Open Database License 1.0", "Open Data Commons Open Database License 1.0", "Open Data Commons Open Database License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "OSL-3.0": ["Open Software License version 3.0", "Open Software License 3.0"],
    "PHP-3.01": ["PHP License, version 3.01", "PHP License 3.01"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python Software Foundation License", "PSF License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL License", "Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "CC0-1.0": ["CC0 1.0 Universal license", "CC0 1.0 License", "CC0 License", "Creative Commons Zero v1.0 Universal license"],
}

# The kinds of the attribution licenses, short and in full.
CC_KINDS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.0": "Generic"}

_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
    " list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
    " materials provided with the distribution."
)
_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
    " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE ARE DISCLAIMED."
)


def _gpl(kind: str, mark: str, version: str) -> str:
    thing = "library" if kind == "Lesser" and version == "2.1" else "program"
    name = f"GNU {kind + ' ' if kind else ''}General Public License"
    return (
        f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the {name}"
        f" as published by the Free Software Foundation{';' if version[0] == '2' else ','} either version {version} of"
        " the License, or (at your option) any later version."
    )


# Notices and conditions that name no title, or wrap it in a wording of their own.
BODIES: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:"
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
    ],
    "BSD-2-Clause": [_CONDITIONS + _DISCLAIMER],
    "BSD-3-Clause": [
        _CONDITIONS + " Neither the name of the copyright holder nor the names of its contributors may be used to"
        " endorse or promote products derived from this software without specific prior written permission." + _DISCLAIMER
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS"
        " SOFTWARE"
    ],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and"
        " to alter it and redistribute it freely, subject to the following restrictions: The origin of this software"
        " must not be misrepresented; you must not claim that you wrote the original software."
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"
        " and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display,"
        " distribute, execute, and transmit the Software"
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
        " publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,"
        " for any purpose, commercial or non-commercial, and by any means."
    ],
    "GPL-2.0": [_gpl("", ";", "2")],
    "GPL-3.0": [_gpl("", ":", "3")],
    "LGPL-2.1": [_gpl("Lesser", ";", "2.1")],
    "LGPL-3.0": [_gpl("Lesser", ":", "3")],
    "AGPL-3.0": [_gpl("Affero", ":", "3")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at"
    ],
}


def templates() -> dict[str, list[str]]:
    """All wordings by SPDX identifier, short notices made from the titles."""
    found = {name: [*texts] for name, texts in BODIES.items()}
    for name, titles in TITLES.items():
        for title in titles:
            found.setdefault(name, []).extend([f"licensed under the {title}", f"under the terms of the {title}"])
        found[name].append(f"SPDX-License-Identifier: {name}")
    found["CC0-1.0"].append("licensed under CC0 1.0")
    for kind, words in CC_KINDS.items():
        for version, area in CC_VERSIONS.items():
            name = f"CC-{kind}-{version}"
            found[name] = [
                f"licensed under CC {kind} {version}",
                f"licensed under the CC {kind} {version} license",
                f"licensed under {name}",
                f"licensed under a Creative Commons {words} {version} {area} License",
                f"licensed under the Creative Commons {words} {version} License",
                f"Creative Commons {words} {version} {area} License",
                f"SPDX-License-Identifier: {name}",
            ]
    return found
