"""Fixed values of the licence scan: template paragraphs by family, and sentences about other things."""

TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Licensed under the BSD 2-Clause license."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL", "Released under the GPL version 2 or later."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher."),
]

OTHERS = [
    "The driver lost his license after the second offence.",
    "You need a fishing license to fish in this river.",
    "The copyright lawyers argued about the terms of the deal.",
    "Students at MIT built a small robot last year.",
    "Two Apache helicopters crossed the border at night.",
    "The public library opens at nine and closes at six.",
    "Mozilla and the other browser makers met in Berlin.",
    "The software version on this phone is old.",
    "A permission slip must be signed by a parent.",
    "The rights of the workers were reserved for a later debate.",
    "The commons were used by all villagers for grazing.",
    "The foundation was laid in general conditions of frost.",
    "He asked for a copy of the source of that story.",
    "Seats are reserved for members of the public.",
]

#: Words of everyday English, which are no sign of a licence.
EVERYDAY = """
a above all also an and any appear are as at be but by can code copy deal either except extent file files following for form forms
free from general has have if in including into is it its later law library may met no not of on one or other part person possible prior
program provided public purpose related same sell she source subject terms that the their they this to under use version was were which with
without work written you your
""".split()
