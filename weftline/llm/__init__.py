"""Training-data operators: media, licences, language, quality, archives, HTML, decontamination, de-duplication, packing.

Nothing outside this subpackage imports it; the entry module adds its queries only where it is present.
"""
