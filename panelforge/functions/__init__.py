from panelforge.functions import ratios, recode, scalars

__all__ = ["ratios", "recode", "scalars"]
